"""N-gram join, centroid clustering and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import clustering, near_dedup, ngram_join, prefix_trie
from tests.llm.conftest import prose
from tests.llm.test_corpus_operators import brute_components, families, shared_boilerplate
from tests.llm.test_ragged_rows import bag
from tests.llm.test_text_operators import WORD, rows

DATA = "/root/testdata/sf0.001"


# --- n-gram join


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (1, 60)])
@pytest.mark.parametrize("made", [families, shared_boilerplate])
def test_join(make, made, width, percent):
    texts = made()
    got = rows(ngram_join.joined(make(texts), width, percent))
    sizes, comp = brute_components(texts, width, percent)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == list(zip(sizes, comp))


def chains():
    """Texts that each differ from the next by a few words: the ends of a chain are far apart; two chains share a passage."""
    r, out = random.Random(8), []
    shared = prose(900, 30).split()
    for c in range(3):
        words = [f"c{c}w{i}" for i in range(60)] + shared
        for _ in range(12):
            out.append(" ".join(words))
            words = list(words)
            words[r.randrange(60)] = f"n{r.randrange(10**6)}"
    return out + [" ".join(shared)] * 2 + [" ".join(shared[:-1])]


def test_join_of_chains_in_small_batches(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BATCH_GRAMS", 100)
    texts = chains()
    got = rows(ngram_join.joined(make(texts), 4, 85))
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(texts, 4, 85)[1]


def test_join_without_leaders_finds_the_same(make, monkeypatch):
    """All links between components come from the exact meetings alone."""
    monkeypatch.setattr(ngram_join, "_led", lambda early, percent: early.limit(0).select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    for texts in (chains(), families()):
        got = rows(ngram_join.joined(make(texts), 4, 85))
        assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(texts, 4, 85)[1]


def test_overlaps_are_summed_over_fragments(spark):
    r = random.Random(4)
    held = {i: r.sample(range(300), r.randrange(20, 120)) for i in range(12)}
    order = spark.createDataFrame([(i, len(s), h, float(h % 7 + h / 1000)) for i, s in held.items() for h in s], "rep bigint, n bigint, h bigint, place double")
    cut = ngram_join.segments(order, 8).cache()
    assert cut.select("fragment").distinct().count() > 4
    sets = spark.createDataFrame([(i, len(s)) for i, s in held.items()], "rep bigint, n bigint")
    pairs = spark.createDataFrame([(i, j) for i in held for j in held if i < j], "a bigint, b bigint")
    got = {tuple(x) for x in ngram_join.linked(pairs, cut, sets, 20).collect()}
    assert got == {(i, j) for i in held for j in held if i < j and 100 * len({*held[i]} & {*held[j]}) >= 20 * len({*held[i]} | {*held[j]})} != set()


def test_join_of_ragged_and_no_rows(ragged, empty):
    want = bag(near_dedup.components(ragged, 5, 80), "doc_id", "n_shingles", "component_id")
    assert bag(ngram_join.joined(ragged, 5, 80), "doc_id", "n_shingles", "component_id") == want
    assert ngram_join.joined(empty).collect() == []


def test_join_of_a_very_long_text(make):
    words = [f"w{i % 70_001}" for i in range(400_000)]
    texts = [" ".join(words), " ".join(words[:-1000]), "short one here and now"]
    got = rows(ngram_join.joined(make(texts), 4, 85))
    assert [got[i]["component_id"] for i in range(3)] == [0, 0, 2]


# --- clustering


def brute_clusters(found, k, rounds, dimensions, scale=1024):
    """found: (vec_id, components)"""
    fit = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in found if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in fit if i is not None)
    centroids = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in fit]
        members = [[v for (_, v), j in zip(fit, own) if j == c] for c in range(len(centroids))]
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centroids)]
    return sorted(((i, j, d) for (i, v) in fit for d, j in [near(v)]), key=repr), centroids


def vectors(dimensions, n=150, seed=2):
    r = np.random.default_rng(seed)
    centers = r.normal(0, 1, (5, dimensions))
    found = [(i, [float(x) for x in (centers[i % 5] + r.normal(0, 0.4, dimensions)).astype(np.float32)]) for i in range(n)]
    odd = [(900, None), (901, []), (902, found[0][1][:-1]), (903, [None, *found[0][1][1:]]), (904, [float("nan"), *found[0][1][1:]]), (905, [float("-inf"), *found[0][1][1:]])]
    return found + odd + [(None, found[7][1]), (3, found[3][1]), (3, found[3][1]), (3, found[4][1]), (-5, [0.0] * dimensions), (-6, [0.0] * dimensions)]


def framed(spark, found):
    return spark.createDataFrame(found, "vec_id bigint, embedding array<float>").withColumns({"v": F.lit(1), "cluster": F.lit("x"), "d": F.lit(0)}).repartition(3)


@pytest.mark.parametrize("dimensions, k", [(6, 8), (64, 8), (2, 20), (1, 300)])
def test_clusters(spark, dimensions, k):
    found = vectors(dimensions)
    got, centroids = clustering.clustered(framed(spark, found), k=k, rounds=4, dimensions=dimensions)
    want, centers = brute_clusters(found, k, 4, dimensions)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and centroids.tolist() == centers


def test_nearest_prefers_small_numbers_and_skips_far_centroids():
    r = np.random.default_rng(3)
    centroids = r.integers(-50, 50, (40, 3))
    centroids[20:30] = centroids[:10]
    v = np.concatenate([r.integers(-60, 60, (500, 3)), centroids])
    number, distance, taken = clustering.nearest(v, centroids)
    every = ((v[:, None] - centroids[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all() and taken < every.size * 0.9


def test_no_vectors_and_large_ones(spark):
    assert clustering.clustered(framed(spark, [(1, None), (2, [1.0])]))[0].collect() == []
    with pytest.raises(Exception, match="too large"):
        clustering.whole_vectors(framed(spark, [(1, [3e38] * 64)])).collect()


# --- prefix trie


def brute_trie(found):
    """found: (conv_id, turn, role, text)"""
    own = {}
    for c, turn, role, text in found:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in own.items()}
    back = lambda c: c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(back(c), [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, spared = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            spared[p[:d]] += (len(m) - 1) * words
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted((len(p), min(m), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], spared[p], ends(p)) for p, m in members.items())


def shown(nodes):
    return sorted(tuple(r) for r in nodes.select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def talks(seed, n=120, longest=15, kinds=3):
    r = random.Random(seed)
    found = []
    for c in range(-5, n):
        for t in range(r.randrange(1, longest)):
            found.append((c, t, r.choice(["user", "assistant"]) if t % 5 else "user", f"turn {r.randrange(kinds) if t % 4 else 0} of {t}" + " word" * (t % 3)))
    found += [(3, 0, "user", "turn 0 of 0")] * 2 + [(5, None, None, "first"), (5, None, "user", None), (None, 0, "user", "lost"), (7, 2, None, None), (8, 1, "", "x " * 50_000)]
    found += [(200 + i, t, "user", f"the same {t}") for i in range(45) for t in range(30)]  # copies
    found += [(300 + 20 * i + 1, 0, "user", "only") for i in range(9)]  # no source; some are without turns
    r.shuffle(found)
    return found


@pytest.mark.parametrize("size, seed", [(4, 1), (1, 2), (3, 3), (64, 4)])
def test_trie(spark, size, seed):
    found = talks(seed)
    frame = spark.createDataFrame(found, "conv_id bigint, turn bigint, role string, text string").withColumns({"i": F.lit(1), "words": F.lit("x"), "depth": F.lit(2), "source": F.lit("y")}).repartition(3)
    assert shown(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(frame)), size)) == brute_trie(found)


def test_trie_of_long_conversations_that_branch_often(spark):
    """Each conversation leaves the one before it, so chains hang below each other many times."""
    turns = [(c, i, "r", f"{min(c, i)}", 1) for c in range(25) for i in range(c + 2)]
    convs = spark.range(25).withColumnRenamed("id", "conv_id")
    got = shown(prefix_trie.trie(convs, spark.createDataFrame(turns, "conv_id bigint, i bigint, role string, digest string, words bigint")))
    built = {c: tuple(f"{min(c, i)}" for i in range(c + 2)) for c in range(25)}
    nodes = {p[:d] for p in built.values() for d in range(len(p) + 1)}
    assert len(got) == len(nodes)
    for depth, conv, _, n, kids, leaves, spared, _ in got:
        p = built[conv][:depth]
        below = [q for q in nodes if q[:depth] == p]
        assert n == sum(x[:depth] == p for x in built.values()) and kids == sum(len(q) == depth + 1 for q in below)
        assert leaves == sum(not any(x[:-1] == q for x in nodes if x) for q in below)
        assert spared == sum((sum(x[: len(q)] == q for x in built.values()) - 1) for q in below if q)


def test_ends_of_many_neighbouring_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_BITS", 2)
    ids = [-9, -8, -1, 0, 3, 4, 5, 99, 100, 1000]
    ends = spark.createDataFrame([(d, 1, 1, c) for c in ids for d in (1, 2)], "depth bigint, x1 bigint, x2 bigint, conv_id bigint").repartition(5)
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted((r["depth"], r["ends_sha256"]) for r in prefix_trie.end_digests(ends).collect()) == [(1, want), (2, want)]


def test_trie_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(none))).collect() == []


# --- the queries against their SQL


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("module, name", [(ngram_join, "op11_ngram_join"), (clustering, "op12_clustering"), (prefix_trie, "op13_prefix_trie")])
def test_queries_equal_their_sql(spark, module, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = getattr(module, name)(spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(getattr(module, name.split("_")[0].upper() + "_SQL"))
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want

"""Operators that compare documents, learn or sample, against brute force or properties."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import mixing, near_dedup, quality_classifier, substring_dedup, url_filter
from stemma.llm.common import connected_components
from tests.llm.conftest import odd_texts, prose
from tests.llm.test_text_operators import WORD, rows


def removed(texts, n=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if s in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shared_texts():
    common, line = prose(70, 60), "A line that many documents share, with more than a hundred bytes in it so that it counts as repeated text."
    r = random.Random(5)
    texts = [prose(100 + i, 40) + " " + line + " " + prose(200 + i, 20) for i in range(30)]
    texts += [common[k : k + 250] + prose(300 + k, 10) for k in range(0, 80, 7)]
    texts += [prose(400 + i, 30) + common[r.randrange(50) :] for i in range(10)]
    return texts + odd_texts() + [prose(1, 120)] * 5


@pytest.mark.parametrize("group", [2048, 2])
def test_substring_dedup(make, group, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    texts = shared_texts()
    marks = substring_dedup.repeated_marks.__defaults__
    monkeypatch.setattr(substring_dedup.repeated_marks, "__defaults__", (group,))
    got = rows(substring_dedup.deduplicated(make(texts)))
    assert marks == (2048,)
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == removed(texts)


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(1)
    made = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(0, 40))) for _ in range(7)]
    runs = [substring_dedup.front_coded([(s, b"", i, 0) for s in run]) for i, run in enumerate(made)]
    merged = list(substring_dedup.merged([substring_dedup.decoded(b) for b in runs]))
    assert [s[0] for _, s in merged] == sorted(s for run in made for s in run)
    for (_, a), (lcp, b) in zip(merged, merged[1:]):
        assert lcp == substring_dedup.common_prefix(a[0], b[0], 0)


def components_of(n, links):
    comp = list(range(n))
    for _ in range(n):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = WORD.findall(low)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], components_of(len(sets), links)


def families():
    """Near copies of a base with more and more edits: links chain through members, far from any leader."""
    r = random.Random(9)
    texts = odd_texts()
    for f in range(3):
        words = prose(500 + f, 150).split()
        for k in range(14):
            w = list(words)
            for _ in range(k % 9):
                w[r.randrange(len(w))] = f"edit{f}x{r.randrange(10**6)}"
            texts.append(" ".join(w))
            if k % 3 == 0:
                words[r.randrange(150)] = f"drift{f}x{k}"
    return texts


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_dedup(make, width, percent):
    texts = families()
    got = rows(near_dedup.components(make(texts), width, percent))
    sizes, comp = brute_components(texts, width, percent)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert all(got[i]["kept"] == (comp[i] == i) for i in range(len(texts)))


def shared_boilerplate():
    """Eight templates with three quarters of their words in common: similar at 0.5 to 0.65, and two near copies of each."""
    r, common = random.Random(21), prose(600, 150).split()
    texts = []
    for f in range(8):
        words = common + [f"own{f}x{i}" for i in range(45)]
        for _ in range(3):
            w = list(words)
            for _ in range(3):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w))
    return texts + [prose(700 + i, 80) for i in range(6)]


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_dedup_compares_all_of_a_bucket(make, width, percent, monkeypatch):
    """One bucket holds all documents: every link shows only there."""
    monkeypatch.setattr(near_dedup, "banded", lambda reps: reps.select(F.lit(1).cast("long").alias("band"), "rep", "n"))
    for texts in (shared_boilerplate(), families()):
        got = rows(near_dedup.components(make(texts), width, percent))
        assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(texts, width, percent)[1]


def test_one_of_each(make, spark):
    texts = families()
    docs = make(texts)
    _, comp = brute_components(texts, 5, 80)
    kept = near_dedup.one_of_each(docs.unionByName(docs.where("doc_id = 9")))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp))


def test_estimate_is_near_the_true_similarity():
    r = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.85):
        both = r.integers(0, 1 << 63, int(1000 * j), dtype=np.uint64)
        own = r.integers(0, 1 << 63, (2, (1000 - len(both)) // 2), dtype=np.uint64)
        k = near_dedup.sketches([np.concatenate([both, own[0]]), np.concatenate([both, own[1]])])
        n = np.array([len(both) + own.shape[1]], float)
        assert abs(near_dedup.estimate(k[:1], k[1:], n, n)[0] - j) < 0.15


@pytest.mark.parametrize("percent", [80, 85])
def test_no_link_is_lost_by_bands_or_the_estimate(percent):
    """Pairs at the threshold, of sets of many sizes and of unequal ones: all share a band and reach the estimate's floor."""
    r = np.random.default_rng(percent)
    pairs = []
    for _ in range(1500):
        union = int(r.integers(20, 500))
        shared = -(-percent * union // 100)
        items = r.integers(0, 1 << 63, union, dtype=np.uint64)
        cut = shared + int(r.integers(0, union - shared + 1))
        pairs.append((items[:cut], np.concatenate([items[:shared], items[cut:]])))
    k = near_dedup.sketches([x for p in pairs for x in p])
    n = np.array([len(x) for p in pairs for x in p], float)
    bands = near_dedup._band_hashes(k)
    assert (bands[::2] == bands[1::2]).any(1).all()
    assert (near_dedup.estimate(k[::2], k[1::2], n[::2], n[1::2]) >= percent / 100 - near_dedup.SLACK).all()


def test_connected_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    comp = components_of(260, links)
    assert got == {i: comp[i] for i in {x for e in links if e[0] != e[1] for x in e}}


def test_unfinished_components_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        connected_components(links, rounds=2)


def test_mixing(make, spark):
    texts = [prose(i, 1 + (i * 37) % 300) for i in range(400)] + odd_texts()
    docs = make(texts)
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts)
    sizes = {}
    for r in got:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        sizes.setdefault(r["source"], []).append(r)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = {s: sum(r["size"] for r in sizes[s]) for s in order}
    target, left = {}, 1.5 * sum(total.values())
    free = list(order)
    while free:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] > 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in over} if over else part
        left -= sum(2.0 * total[s] for s in over)
        free = [s for s in free if s in over and False or s not in over] if over else []
    for s in order:
        assert {r["source_size"] for r in sizes[s]} == {total[s]} and all(abs(r["target"] - target[s]) < 1e-6 for r in sizes[s])
        assert abs(sum(r["taken"] for r in sizes[s]) - target[s]) <= 0.01 * target[s]
        assert abs(sum(r["copies"] for r in sizes[s]) - len(sizes[s]) * target[s] / total[s]) < 1
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_flight_keeps_totals_and_leaves_two_open(monkeypatch):
    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 500, 300), np.full(300, 0.37)
    q = mixing.fly(size, p, np.random.default_rng(1))
    assert ((q > 0) & (q < 1)).sum() <= 2 and np.isclose(q.sum(), p.sum()) and np.isclose(q @ size, p @ size)
    for land in (False, True):
        mean = np.mean([mixing.fly(size[:12], p[:12], np.random.default_rng(k), land) for k in range(3000)], axis=0)
        assert np.abs(mean - 0.37).max() < 0.05
    for alike in (np.full(9, 7.0), np.array([5.0, 5.0]), np.zeros(4), np.array([3.0])):
        q = mixing.fly(alike, np.full(len(alike), 0.5), np.random.default_rng(4))
        assert ((q > 0) & (q < 1)).sum() <= 1 and np.isclose(q.sum(), len(alike) / 2)
    landed = [mixing.fly(size, p, np.random.default_rng(k), True) for k in range(20)]
    assert all(set(q) <= {0.0, 1.0} and abs(q.sum() - p.sum()) < 1 and abs(q @ size - p @ size) < size.max() for q in landed)


def nearest_subset(size, p):
    """Least miss of the words due by subsets that miss the documents due by less than one."""
    subsets = [[i >> k & 1 for k in range(len(p))] for i in range(1 << len(p))]
    return min(abs(float(np.dot(s, size) - np.dot(size, p))) for s in subsets if abs(sum(s) - sum(p)) < 1 - 1e-9)


def test_landing_is_the_design_that_changes_least():
    size = np.array([270.0, 60, 50, 40, 30, 8])
    for p in (np.full(6, 0.54), np.array([0.9, 0.1, 0.3, 0.3, 0.7, 0.2]), np.full(6, 0.5)):
        free = np.array([mixing.land(size, p, np.random.default_rng(k)) for k in range(3000)])
        assert np.abs(free.mean(0) - p).max() < 0.04 and (np.abs(free.sum(1) - p.sum()) < 1).all()
        for near in (0.0, 25.0, 90.0):
            landed = [mixing.land(size, p, np.random.default_rng(k), near) for k in range(40)]
            assert all(abs(q @ size - p @ size) <= max(near, nearest_subset(size, p)) + 1e-6 and abs(q.sum() - p.sum()) < 1 for q in landed)
    # {0} and {1, 2} miss nothing: chances of one half each change no probability, and no other design over them is as good
    landed = np.array([mixing.land(np.array([2.0, 1, 1]), np.full(3, 0.5), np.random.default_rng(k), 0.0) for k in range(2000)])
    assert {tuple(q) for q in landed} == {(1, 0, 0), (0, 1, 1)} and np.abs(landed.mean(0) - 0.5).max() < 0.05
    assert list(mixing.land(np.zeros(0), np.zeros(0), np.random.default_rng(0))) == []


def test_small_sources_meet_their_targets(spark):
    r = np.random.default_rng(9)
    docs = [(i, " ".join(["w"] * int(r.lognormal(4, 1.2))), f"s{i % 6}") for i in range(60)]
    of = {}
    for x in mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect():
        of.setdefault(x["source"], []).append(x)
    missed = 0
    for found in of.values():
        size, target = np.array([x["size"] for x in found]), found[0]["target"]
        ratio = target / size.sum()
        bound = max(mixing.NEAR * target, nearest_subset(size, np.full(len(size), ratio % 1)) if ratio % 1 else 0)
        assert abs(sum(x["taken"] for x in found) - target) <= bound + 1e-6
        assert abs(sum(x["copies"] for x in found) - len(found) * ratio) < 1 and all(x["copies"] in (0, 1, 2) for x in found)
        missed += bound > 0
    assert missed >= 3


def test_mixed_rows(make):
    docs = make([prose(i, 50) for i in range(60)])
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    got = {}
    out = mixing.mixed(docs)
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want and out.columns == docs.columns


def test_classifier_sample_is_filled_from_short_texts(make, spark, monkeypatch):
    docs = make(["long " * 50 if i % 2 else f"short {i}" for i in range(80)] + [None])
    labels = spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(120)], "doc_id bigint, quality int, toxic int")
    learned = []
    monkeypatch.setattr(quality_classifier, "train", lambda texts, of: learned.append((texts, list(of))))
    short = [i for i in range(0, 81, 2) if zlib.crc32(str(i).encode()) % 5]
    for n in (10, 1000):
        quality_classifier.fit(docs, labels, n, 100)
        texts, of = learned.pop()
        assert len(texts) == len(of) == min(n, len(short)) and all(len(t) < 100 for t in texts)


def test_classifier_learns_and_scores_alike(make, spark):
    texts = [prose(i, 80) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i, 60).split()) for i in range(300)]
    docs = make([*texts, None, "", texts[0], "x" * 5000])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, None, None), (0, 0, 0)], "doc_id bigint, quality int, toxic int")
    net = quality_classifier.fit(docs, labels, 200)
    got = rows(quality_classifier.score(docs, net))
    assert len(got) == 304 and got[302]["score"] == got[0]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [i for i in range(300) if got[i]["held_out"]]
    assert held and np.mean([got[i]["predicted"] == (i % 3 > 0) for i in held]) > 0.95
    kept = quality_classifier.keep_good(docs, net)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 4, 511, 512, 513, 5000):
        padded, chunks, first = quality_classifier.laid_out(np.zeros(n, np.uint8), np.array([0, n]))
        steps = max(1, -(-n // 4))
        assert chunks[0, 0] == 0 and chunks[-1, 1] == steps and (chunks[1:, 0] <= chunks[:-1, 1]).all() and (chunks[:, 1] > chunks[:, 0]).all()


def test_url_filter(spark):
    page = lambda head: f"<html><head>{head}</head><body>canonical refresh</body></html>"
    given = [
        ("http://a.net/x", page('<link rel="canonical" href="//b.net/y">')), ("http://b.net/y", page('<META http-equiv=Refresh content="0; url=http://www.Example.org/es/z">')),
        ("https://c.net/1?q#f", page("<link href='/2' rel=canonical>")), ("http://c.net/2", page('<link rel="canonical" href="http://x.com/de/">')), ("http://c.net/3", page('<link rel="canonical" href="2">')),
        ("http://d.net/", page('<link rel="canonical" href="http://e.org/ok">')), ("http://f.net/", page('<meta http-equiv="refresh" content="1;url=http://d.net/">')),
        ("http://f.net/", page('<link rel="canonical" href="http://y.com/de/q">')), ("no url", None), (None, None), ("http://sub.example.org:80/en/1", None), ("HTTP://ExAmple.ORG/en/12", ""), ("x://org", None), ("http://org/", None),
        ("http://plain.net/a", page("")), ("http://q.com/fr/", None), ("http://q.com/de/", None),
    ]
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(given)], "page_id bigint, url string, html string, verdict string")
    got = rows(url_filter.judge_pages(df), "page_id")
    verdicts = [got[i]["verdict"] for i in range(len(given))]
    assert verdicts == ["block", "block", "block", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow", "block"]
    assert [got[i]["rule"] for i in (10, 11, 12, 13, 14, 15)] == [None, "example.org/en/1", None, "org/", None, "com/fr/"]
    assert (got[10]["host"], got[10]["path"], got[2]["path"], got[8]["host"]) == ("sub.example.org:80", "/en/1", "/1", "")


def test_pages_that_differ_in_the_query_alone_are_two(spark):
    link = lambda to: f'<link rel="canonical" href="{to}">'
    given = [
        ("http://x.net/view?id=1", link("http://y.com/de/a?b")), ("http://x.net/view?id=2", None), ("https://x.net/view?id=1#part", None), ("http://x.net/view", None),
        ("http://x.net/view?id=3", link("?id=1")), ("http://x.net/view?id=4", link("#top")), ("http://x.net/go?to=http://y.com/", link("view?id=2&u=http://y.com/de/")), ("http://x.net/view?id=2&u=http://y.com/de/", None), ("http://z.net?id=1", link("/a")),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(given)], "page_id bigint, url string, html string")
    got = rows(url_filter.judge_pages(df), "page_id")
    assert [got[i]["verdict"] for i in range(len(given))] == ["block", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow"]


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == [] and near_dedup.components(empty).collect() == []
    assert near_dedup.one_of_each(empty).collect() == [] and substring_dedup.deduplicated(empty).collect() == []
    assert quality_classifier.score(empty, quality_classifier.fit(empty, labels)).collect() == []
    assert url_filter.judge_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []

"""Repeated rows, rows without doc_id and doc_ids with several texts: every operator and stage against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemma.llm import bpe, fingerprints, mixing, near_dedup, pii, quality_classifier, quality_rules, substring_dedup, token_files
from stemma.llm.common import range_block, row_keys
from tests.llm.conftest import prose, ragged_rows
from tests.llm.test_corpus_operators import brute_components, removed
from tests.llm.test_text_operators import PLAIN, WORD, naive_containment, naive_marks, repeated, valid

ROWS = ragged_rows()


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def tie(ragged):
    """Digest of each row by (doc_id, text)."""
    return {(r["doc_id"], r["text"]): r["tie_"] for r in ragged.select("doc_id", "text", F.xxhash64("text").alias("tie_")).collect()}


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_quality_rules(ragged):
    def base(i, t):
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n = repeated(words)
        return i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(words) < 20 or 100 * n > 30 * len(words)

    got = quality_rules.judge(ragged)
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter(base(*r) for r in ROWS)


def test_quality_classifier(ragged, spark):
    labels = spark.createDataFrame([(i, int(i is not None and i > 20), 0) for i, _ in ROWS] + [(40, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    net = quality_classifier.fit(ragged, labels)
    got = quality_classifier.score(ragged, net).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in ROWS)
    want = sorted(round(naive_score(net, (t or "").encode()), 3) for _, t in ROWS)
    assert np.allclose(sorted(round(r["score"], 3) for r in got), want, atol=0.0021)
    assert quality_classifier.keep_good(ragged, net).count() == sum(r["predicted"] for r in got)
    assert quality_classifier.fit(ragged, labels, 5).table.shape == (256, quality_classifier.DIM)


def naive_score(net, raw):
    """The forward pass by its definition, one chunk and one filter at a time."""
    step, steps = quality_classifier.STEP, max(1, -(-len(raw) // quality_classifier.STEP))
    codes = np.frombuffer(raw.ljust((steps + 1) * step, b"\0"), np.uint8)
    windows = [net.table[codes[k * step : (k + 2) * step]].ravel().astype(np.float64) @ net.filters + net.bias for k in range(steps)]
    width, stride = quality_classifier.CHUNK // step, quality_classifier.STRIDE // step
    chunks, at = [], 0
    while True:
        chunks.append(np.maximum(np.max(windows[at : at + width], axis=0), 0))
        if at + width >= steps:
            break
        at += stride
    hidden = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return float(1 / (1 + np.exp(-(hidden @ net.out + net.shift[0]))))


def in_order(tie):
    return sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, tie[r]))


def test_token_files(ragged, tie, tok):
    got = sorted(token_files.read_segments(token_files.write_segments(ragged, segment_ids=400)).collect(), key=lambda r: r["start"])
    start = 0
    for r, (i, t) in zip(got, in_order(tie), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_substring_dedup(ragged):
    k1, k2 = row_keys()
    keys = {(r["doc_id"], r["text"]): r["k2_"] for r in ragged.select("doc_id", "text", k2.alias("k2_")).collect()}
    order = sorted(set(ROWS), key=lambda r: (r[0] is not None, r[0] or 0, keys[r]))
    want = dict(zip(order, removed([t for _, t in order])))
    got = bag(substring_dedup.deduplicated(ragged), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter((r[0], *want[r]) for r in ROWS)


def test_long_texts_are_cut_into_pieces(make, monkeypatch):
    line = "A line that comes back in the same text and in others, with more than a hundred bytes in it, so it counts. "
    texts = [prose(1, 900) + line + prose(2, 700) + line, prose(3, 400) + line * 3, prose(1, 900), "x" * 3000]
    monkeypatch.setattr(quality_classifier, "BLOCK", 3)
    net = quality_classifier.train([], np.zeros(0))
    for t in texts:
        raw = t.encode()
        got = quality_classifier.scores(net, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert abs(got[0] - naive_score(net, raw)) < 1e-4
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "PIECE", 500)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["doc", "text"])
    rows = pa.Table.from_batches(list(substring_dedup._anchor_rows(iter([batch]))))
    kept = rows.filter(pa.compute.less_equal(rows["kind"], substring_dedup.G_MANY)).to_pydict()
    grams = {t.encode()[a : a + substring_dedup.GRAM] for t in texts for a in range(len(t) - substring_dedup.GRAM + 1)}
    for doc, p in zip(kept["doc"], kept["p"]):
        at = (p >> 32) + (p >> 16 & 0xFFFF)
        assert texts[doc].encode()[at : at + substring_dedup.GRAM] in grams


def brute_terms(rows, least=pii.GENERALISE):
    """Spans of each row, base ones first, then terms of that disclosure at least, by the formula over all documents."""
    from math import log2

    held, terms = [], []
    for _, t in rows:
        found = [(k, m.start(), m.end(), m.group()) for k, p in PLAIN.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        rest = list(t or "")
        for _, a, b, _ in found:
            rest[a:b] = " " * (b - a)
        places = []
        for m in WORD.finditer("".join(rest)):
            core = re.sub(r"^[\W_]+|[\W_]+$", "", m.group()) if not re.search("[^\x00-\x7f]", m.group()) else m.group()
            if core:
                a = m.start() + m.group().index(core)
                places.append((core.lower(), a, a + len(core)))
        name = lambda k, v: f"{k}:{re.sub('[^0-9]', '', v) if k in ('card', 'phone') else v.lower()}"
        held.append((found, {name(k, v) for k, _, _, v in found}, "".join(rest)))
        terms.append(places)
    n = len(rows)
    docs_of = {}
    for i, places in enumerate(terms):
        for w in {w for w, _, _ in places}:
            docs_of.setdefault(w, set()).add(i)
    of_entity = {}
    for i, (_, entities, _) in enumerate(held):
        for e in entities:
            of_entity.setdefault(e, set()).add(i)
    two = lambda ids: len({held[i][2] for i in ids}) > 1
    out = []
    for i, (found, entities, _) in enumerate(held):
        spans = [(k, a, b) for k, a, b, _ in found]
        for w, a, b in terms[i]:
            for e in sorted(entities):
                both = of_entity[e] & docs_of[w]
                if two(of_entity[e]) and len(of_entity[e]) < n and two(both) and log2(n * len(both) / (len(docs_of[w]) * len(of_entity[e]))) / log2(n / len(of_entity[e])) >= least:
                    spans.append(("term", a, b))
                    break
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    return out


def test_personal_data(ragged):
    want = Counter((i, s, s.count("term:")) for (i, _), s in zip(ROWS, brute_terms(ROWS)))
    assert bag(pii.report(ragged), "doc_id", "spans", "n_term") == want and sum(n for (_, _, k), n in want.items() if k) == 4
    clean = pii.sanitise(ragged)
    assert clean.columns == ragged.columns
    assert Counter(r["doc_id"] for r in clean.collect() if "[EMAIL]" in (r["text"] or "") and "[TERM]" in r["text"]) == Counter({50: 3, None: 1})
    assert clean.where("text like '%jo.doe%'").count() == 0


def test_many_entities_and_terms(make):
    """Several entities of different frequency, terms with one or more of them, and terms of no one's."""
    texts = []
    for i in range(150):
        t = prose(2000 + i, 30)
        if i % 4 == 0:
            t += f" mail{i % 12}@example.org Zquark{i % 12}"
        if i % 5 == 0:
            t = f"Common{i % 3} " + t
        if i % 20 == 0:
            t += f" +4930123450{i % 40:02d} Ybar{i % 40} (Ybar{i % 40})"
        texts.append(t)
    want = brute_terms(list(enumerate(texts)))
    assert sum(s.count("term:") for s in want) > 20
    assert bag(pii.report(make(texts)), "doc_id", "spans") == Counter(enumerate(want))


def test_bpe(ragged, tok):
    def digest(i, t):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert bag(bpe.digests(ragged), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter(digest(*r) for r in ROWS)


def test_mixing(ragged):
    got = mixing.mix(ragged).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in ragged.collect())
    assert bag(mixing.mix(ragged.repartition(7)), "doc_id", "source", "size", "taken") == Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got)
    want = Counter()
    for r in got:
        if r["copies"]:
            want[r["doc_id"], r["source"]] += r["copies"]
    out = mixing.mixed(ragged)
    assert out.columns == ragged.columns and bag(out, "doc_id", "source") == want


def test_fingerprints(ragged, tie):
    order = in_order(tie)
    texts = [t or "" for _, t in order]
    want = Counter()
    for k, (i, _) in enumerate(order):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (naive_marks(x.encode()) for x in (t, new, following))
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.as_text(a), fingerprints.as_text(b), naive_containment(a, b), naive_containment(a, c)] += 1
    for blocks in (1, 6):
        assert bag(fingerprints.fingerprints(ragged, blocks), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == want


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_dedup(ragged, width, percent):
    sizes, comp = brute_components([t for _, t in ROWS], width, percent)
    least = {}
    for k, (i, _) in enumerate(ROWS):
        if sizes[k] and i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    want = Counter()
    for k, (i, _) in enumerate(ROWS):
        c = least.get(comp[k]) if sizes[k] else i
        want[i, sizes[k], c, c is None or i == c] += 1
    assert bag(near_dedup.components(ragged, width, percent), "doc_id", "n_shingles", "component_id", "kept") == want
    kept = near_dedup.one_of_each(ragged, width, percent)
    stays = Counter(least.get(c) for c in {comp[k] for k in range(len(ROWS)) if sizes[k]}) + Counter(i for k, (i, _) in enumerate(ROWS) if not sizes[k])
    assert kept.columns == ragged.columns and bag(kept, "doc_id") == Counter({(i,): n for i, n in stays.items()})


def test_ranges_split_values_of_many_rows(spark):
    df = spark.createDataFrame([(i if i > 60 else None if i < 30 else 7, str(i)) for i in range(100)], "v bigint, t string").withColumn("h", F.xxhash64("t"))
    block, n = range_block(df, "v", F.col("h"), 10)
    got = df.select("v", "h", block.alias("b")).collect()
    by = sorted(got, key=lambda r: (r["v"] is not None, r["v"] or 0, r["h"]))
    assert [r["b"] for r in by] == sorted(r["b"] for r in got) and 0 <= by[0]["b"] and by[-1]["b"] < n
    assert max(Counter(r["b"] for r in got).values()) < 30


def test_pipeline_stages(ragged, spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in ROWS if i is not None], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, ragged, str(tmp_path))
        n = out.count()
        assert 0 < n <= 3 * len(ROWS), name
        if name != "tokens":
            assert out.columns == ragged.columns, name
        empty = stage(spark, ragged.limit(0), str(tmp_path))
        assert empty.count() == 0, name

"""Operators that look at one text at a time, against plain-Python versions."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import bpe, fingerprints, pii, quality_rules, token_files
from stemma.llm.common import byte_view
from stemma.llm.gear import boundaries
from tests.llm.conftest import odd_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def repeated(words):
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(j for i in at for j in range(i, i + 8))
    return len(hit)


def test_quality_rules_base(odd):
    got = rows(quality_rules.judge(odd))
    for i, t in enumerate(odd_texts()):
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated(words))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        failed = len(words) < 20 or 100 * want[4] > 30 * len(words)
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert got[0]["kept"] and got[9]["kept"]


def plain_votes(t):
    t = t or ""
    words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    n, chars = len(words), sum(map(len, words))
    symbols, bangs, stops, upper = (sum(c in s for c in t) for s in ("#*$%&|<>", "!", ".", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    low = lambda x, good, bad: 0 if not n else -1 if x > bad else int(x < good)
    mean, distinct = chars / max(1, n), len(set(words)) / max(1, n)
    return (
        low(symbols / max(1, n), 0.05, 0.3), low(symbols / max(1, chars), 0.01, 0.05), low((symbols + bangs + stops) / max(1, chars), 0.06, 0.1), low(bangs / max(1, n), 0.05, 0.3),
        low(upper / max(1, chars), 0.1, 0.3), low(repeated(words) / max(1, n), 0.1, 0.3), low((len(lines) - len(set(lines))) / max(1, len(lines)), 0.05, 0.3),
        0 if n < 50 else -1 if distinct < 0.1 else int(distinct > 0.2), 0 if not n else -1 if mean < 2 or mean > 15 else int(3 < mean < 9), 0 if n < 30 else -1 if stops / n < 0.01 else int(stops / n > 0.02),
    )


def plain_em(v, n, rules):
    """Posterior of each vote pattern in v, seen n times."""
    start_good, start_bad, a = (np.array(x) for x in (quality_rules.START_GOOD, quality_rules.START_BAD, quality_rules.PRIOR))
    good, odds = 0.8, np.tile(np.log(start_good / start_bad), (rules, 1))
    posterior = lambda: 1 / (1 + np.exp(-(np.log(good / (1 - good)) + odds[np.arange(rules), v + 1].sum(1))))
    of = lambda w: np.array([[(w * (v[:, j] == k)).sum() for k in (-1, 0, 1)] for j in range(rules)])
    for _ in range(25):
        q = posterior()
        odds = np.log((of(n * q) + a * start_good) / ((n * q).sum() + a)) - np.log((of(n * (1 - q)) + a * start_bad) / ((n * (1 - q)).sum() + a))
        good = min(0.99, max(0.01, ((n * q).sum() + 1) / (n.sum() + 2)))
    return posterior(), good, odds


def test_quality_rules_keep_what_plain_estimation_keeps(make):
    texts = odd_texts() + [prose(i, 60) + "." for i in range(40)] + ["!! $$ " + " ".join(w.upper() + "!#" for w in prose(i, 40).split()) for i in range(15)] + ["na na " * 40 + prose(i, 9) for i in range(5)]
    v = np.array([plain_votes(t) for t in texts])
    q = plain_em(v, np.ones(len(v)), v.shape[1])[0]
    got = rows(quality_rules.judge(make(texts)))
    assert np.allclose([got[i]["posterior"] for i in range(len(texts))], q, atol=1e-6)
    assert [got[i]["kept"] for i in range(len(texts))] == [bool(not got[i]["base_failed"] and q[i] >= 0.5) for i in range(len(texts))]
    assert 0 < sum(r["kept"] for r in got.values()) < len(texts) and any(not r["kept"] and not r["base_failed"] for r in got.values())


def test_quality_rules_estimate_matches_plain_em(spark):
    patterns = [([1, 1, 0], 60), ([1, -1, 1], 10), ([-1, -1, 0], 15), ([0, 0, 0], 3), ([-1, 1, -1], 4)]
    voted = spark.createDataFrame([(v,) for v, n in patterns for _ in range(n)], "v array<int>")
    v, n = np.array([p[0] for p in patterns]), np.array([p[1] for p in patterns], float)
    _, good, odds = plain_em(v, n, 3)
    found = quality_rules.estimate(voted, 3)
    assert np.allclose(found[0], good) and np.allclose(found[1], odds)


def test_bpe_agrees_with_the_library(odd, tok):
    got = rows(bpe.digests(odd))
    for i, t in enumerate(odd_texts()):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_both_encoders_agree_on_odd_pieces(tok):
    texts = ["<|ENDOFTEXT|> <|endoftext|>. foo<|endoftext|", "\u00e9\u0301 x. \u00e9. \u00bbx\u00bb. foo). foo.) 12., a-b.", "it's we'll 's. DON'T.", "\u0130stanbul \u03a3\u0391\u03a3 \u03a3. \u017f \u212a", "ABC! !!! ...", "\u65e5\u672c\u8a9e 12.34"]
    enc = bpe.encoder(bpe.default_tokenizer())
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, enc.kind).tolist() for x in enc.plain(*byte_view(pa.array(texts)))] == want
    assert [np.frombuffer(x, enc.kind).tolist() for x in enc.chunked(texts)] == want


def test_chunks_are_reused_and_forgotten_by_age(tok):
    enc = bpe.WordEncoder(bpe.default_tokenizer(), max_chunk_bytes=20_000)
    shared = prose(7, 600)
    for k in range(12):
        texts = [prose(100 + k, 500) + " " + shared, shared]
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, enc.kind).tolist() for x in enc.chunked(texts)] == want
    assert enc.reused > 0.5 * enc.met and len(enc.chunks) + len(enc.older) < 150


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files_round_trip(odd, tok):
    segments = token_files.write_segments(odd, segment_ids=500)
    assert segments.count() > 3
    got = rows(token_files.read_segments(segments))
    start = 0
    for i, t in enumerate(odd_texts()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_keep_repeated_and_unnamed_rows(spark):
    df = spark.createDataFrame([(1, "b"), (1, "b"), (None, "c d"), (0, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.read_segments(token_files.write_segments(df)).collect()), key=lambda r: r[2])
    assert [(r[1], r[2], r[3]) for r in got] == [(None, 0, 3), (0, 3, 1), (1, 4, 2), (1, 6, 2)]


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [1, 2, 3, 1000, 1000, 70_000], list(range(0, 9000, 7)), [3] * 300 + [10**9]])
def test_elias_fano(values):
    ef = token_files.EliasFano.of(np.array(values, np.int64))
    again = token_files.EliasFano(**ef.fields())
    assert [again.select(i) for i in range(len(values))] == values
    assert [ef.select(i) for i in range(len(values))] == values


def naive_marks(raw):
    """Chunks by the definition: the gear hash of the 32 bytes that end at each place, one byte at a time."""
    import xxhash

    from stemma.llm.gear import GEAR

    marks, start = {}, 0
    while start < len(raw):
        n = len(raw) - start
        size = min(n, fingerprints.HIGH)
        for k in range(fingerprints.LOW, size):
            h = 0
            for b in raw[start + k - 32 : start + k]:
                h = (h << 1) + int(GEAR[b]) & 0xFFFFFFFF
            if h >> (32 - (7 if k < fingerprints.MEAN else 3)) == 0:
                size = k
                break
        marks[xxhash.xxh32_intdigest(raw[start : start + size])] = size
        start += size
    return marks


def naive_containment(a, b):
    return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)


def test_fingerprints(odd):
    texts = [t or "" for t in odd_texts()]
    got = rows(fingerprints.fingerprints(odd, 3))
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        if len(t) < 10_000:
            a, b, c = (naive_marks(x.encode()) for x in (t, new, following[:10_000]))
            assert r["fingerprint"] == fingerprints.as_text(a) and r["edited_fingerprint"] == fingerprints.as_text(b) and r["near_edited"] == naive_containment(a, b)
            assert len(following) >= 10_000 or r["near_next"] == naive_containment(a, c)
    assert got[0]["near_next"] == 1 and got[1]["near_next"] > 0.7 and 0.3 < got[9]["near_edited"] < 0.7 and got[3]["near_next"] == 1


def test_fingerprints_of_any_number_of_blocks_agree(odd):
    a, b = (sorted(map(repr, fingerprints.fingerprints(odd, n).collect())) for n in (1, 7))
    assert a == b


def test_chunks_resist_shifts():
    text = prose(5, 3000).encode()
    a, b = fingerprints.chunk_marks([text, b"something before " + text])
    assert fingerprints.containment(a, b) > 0.98
    ends = boundaries(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 32, 48, 192)[0]
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= 192 and (sizes[:-1] >= 32).all()


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PRIVATE = [
    "a@b.c_d@e.f x@y @z.z q@w..e.r a.b+c%d@e-f.g.h. ok", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1..2.3.4", "4111 1111 1111 1111 4111111111111111, 4111-1111-1111-1112 12  34 5555555555554444 7",
    "+1 (017) 555-7713 +12 +1234567 ++49 30 1234567- +1.2.3.4.5.6.7.8", "\U0001f600é a@b.cd 10.0.0.1 +4930123456", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 " * 30, "a@" + "b." * 3000 + "c", None, "", "1" * 50_000,
]


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        total = sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d))))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def test_personal_data(make):
    got = rows(pii.report(make(PRIVATE)))
    for i, t in enumerate(PRIVATE):
        found = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        r = got[i]
        assert {k: r[f"n_{k}"] for k in PLAIN} == {k: sum(f[0] == k for f in found) for k in PLAIN}, i
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["spans"] == listed and r["n_term"] == 0


def test_terms_that_give_an_entity_away(make):
    texts = [prose(i, 40) for i in range(40)]
    texts[3] = prose(50, 20) + " Ask Quillfeather, at jo@example.org, The of " + prose(51, 9)
    texts[8] = prose(52, 20) + " Write Quillfeather now jo@example.org and the " + prose(53, 9)
    texts[9] = prose(54, 20) + " Nobody knows Quillfeather."
    got = rows(pii.report(make(texts)))
    assert sorted(i for i, r in got.items() if r["n_term"]) == [3, 8]
    # a third document has the term without the entity: generalised only
    assert "Ask Q., at [EMAIL], The" in rows(pii.sanitise(make(texts)))[3]["text"]
    texts[9] = texts[8][::-1]
    docs = make(texts)
    got = rows(pii.report(docs))
    at = texts[3].index("Quillfeather")
    assert got[3]["spans"].split(",")[1:] == [f"term:{at}:{at + 12}"] and got[8]["n_term"] == 1 and got[0]["spans"] == ""
    clean = rows(pii.sanitise(docs))
    assert clean[3]["text"] == texts[3].replace("jo@example.org", "[EMAIL]").replace("Quillfeather", "[TERM]")
    assert clean[0]["text"] == texts[0] and clean[3]["n_chars"] == len(clean[3]["text"]) and pii.sanitise(docs).columns == docs.columns


def test_terms_far_from_their_entity_and_of_any_shape(make):
    texts = [prose(i, 40) for i in range(80)]
    names = ["Quillfeather", "O'Brien-Zyx", "Qw", "Zoe\u0308", "K-4711"]
    for i in (3, 8):
        texts[i] = " ".join(f"{n}," for n in names) + " " + prose(60 + i, 60) + " jo@example.org"
    docs = make(texts)
    got, clean = rows(pii.report(docs)), rows(pii.sanitise(docs))
    for i in (3, 8):
        at = [texts[i].index(n) for n in names]
        assert {f"term:{a}:{a + len(n)}" for a, n in zip(at, names)} <= set(got[i]["spans"].split(","))
        assert clean[i]["text"].startswith("[TERM], " * len(names)) and clean[i]["text"].endswith("[EMAIL]")
    assert not any(r["n_term"] for i, r in got.items() if i not in (3, 8))


def test_empty_tables(empty):
    assert quality_rules.judge(empty).collect() == [] and bpe.digests(empty).collect() == [] and pii.report(empty).collect() == []
    assert pii.sanitise(empty).collect() == [] and fingerprints.fingerprints(empty).collect() == []
    assert token_files.read_segments(token_files.write_segments(empty)).collect() == []

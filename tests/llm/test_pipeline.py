"""The pipeline's stages on one small table, each against a brute-force version of what it is meant to do."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from stemma.llm import bpe, pii
from stemma.llm.common import saved
from tests.llm.conftest import prose
from tests.llm.test_corpus_operators import brute_components
from tests.llm.test_ragged_rows import brute_terms
from tests.llm.test_text_operators import WORD


def brute_clean(rows):
    """Texts of (doc_id, text) with base spans named, and terms removed or cut to their first letter."""
    out = []
    for (_, t), removed, spans in zip(rows, brute_terms(rows, pii.REMOVE), brute_terms(rows)):
        for kind, a, b in sorted((s.split(":") for s in spans.split(",") if s), key=lambda s: -int(s[1])):
            name = f"[{kind.upper()}]" if kind != "term" or f"term:{a}:{b}" in removed.split(",") else t[int(a)] + "."
            t = t[: int(a)] + name + t[int(b) :]
        out.append(t)
    return out


def brute_targets(rows):
    """Target words of each source of (source, words): weights 5, 2, 1, a share of 1.5, at most 2 of each."""
    size = Counter()
    for source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        left, free = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full), [s for s in order if s not in full]
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if part[s] > 2 * size[s]}
        if not over:
            return {s: part.get(s, 2 * size[s]) for s in order}, size
        full |= over


def test_stages(make, spark, tmp_path):
    r = random.Random(4)
    texts = [prose(i, 60) for i in range(150)]
    texts += [" ".join(w.upper() + "!!" for w in prose(1000 + i, 50).split()) for i in range(60)]
    texts += [t.replace("of", "off", 1) for t in texts[:20]] + texts[20:30] + [prose(3000, 50) + " write to a.b@example.org now", None, ""]
    # three texts that an address and a rare name share, and a name that two more texts hold
    texts += [prose(3001 + k, 50) + f" ask Quillfeather or Ybarra at q.y@example.org, {k} times" for k in range(3)] + [prose(3010 + k, 50) + " Ybarra" for k in range(2)]
    docs = make(texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 150), 0) for i in range(210) if r.random() < 0.9]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixture", "tokens"]
    kept, held = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = saved(stage(spark, kept, str(tmp_path)), name)
        held[name] = kept.collect()
        if name != "tokens":
            assert kept.columns == docs.columns
    good = {x["doc_id"] for x in held["quality"]}
    assert good >= set(range(150)) and not good & set(range(150, 210))
    order = sorted(good)
    _, comp = brute_components([texts[i] for i in order], 5, 80)
    assert {x["doc_id"] for x in held["near_duplicates"]} == {order[c] for c in set(comp)}
    clean = {x["doc_id"]: x["text"] for x in held["personal_data"]}
    assert set(clean) == {x["doc_id"] for x in held["near_duplicates"]}
    assert "write to [EMAIL] now" in clean[240] and "[TERM]" in clean[243] and " Y. " in clean[243] and "[EMAIL]" in clean[243]
    went_in = [(x["doc_id"], x["text"]) for x in held["near_duplicates"]]
    assert dict(zip((i for i, _ in went_in), brute_clean(went_in))) == clean
    words = lambda x: len(WORD.findall(x["text"] or ""))
    target, size = brute_targets([(x["source"], words(x)) for x in held["personal_data"]])
    taken, copies, docs_of = Counter(), defaultdict(Counter), Counter(x["source"] for x in held["personal_data"])
    for x in held["mixture"]:
        assert x["text"] == clean[x["doc_id"]]
        taken[x["source"]] += words(x)
        copies[x["source"]][x["doc_id"]] += 1
    # the texts have nearly one length, so no subset need come nearer than half of it (test_small_sources_... holds the exact bound)
    half = max(map(words, held["personal_data"])) / 2
    for s, due in target.items():
        assert abs(taken[s] - due) <= max(0.005 * due, half) and abs(copies[s].total() - docs_of[s] * due / size[s]) < 1
        assert set(copies[s].values()) <= {int(due / size[s]), int(due / size[s]) + 1}
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    want = Counter()
    for x in held["mixture"]:
        ids = tok.encode(x["text"] or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[x["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter((x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in held["tokens"]) == want
    assert sorted((x["doc_id"], x["n_tokens"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((x["doc_id"], x["n_tokens"]) for x in held["tokens"])

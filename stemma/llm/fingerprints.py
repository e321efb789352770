"""Document fingerprints by content-defined chunking.

Normalised gear-hash boundaries split a text's UTF-8 bytes; a fingerprint is the set of its chunks' digests with
their lengths, as text: 8 hexadecimal digits of digest and 2 of length for each chunk, ordered, joined by a space.
`containment` is the share of one fingerprint's length whose chunks the other has too; an insertion moves only the
chunks around it.

Null texts count as empty; an empty text has an empty fingerprint, alike (1) to an empty one only. Repeated doc_ids
follow each other in the order of a digest of their texts; null doc_ids come first. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import documents, range_block
from stemma.llm.gear import boundaries

LOW, MEAN, HIGH = 32, 48, 192
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

Marks = dict[int, int]  # digest of a chunk -> its length


def chunk_marks(texts: list[bytes]) -> list[Marks]:
    data = b"".join(texts)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    cuts = boundaries(np.frombuffer(data, np.uint8), offsets, LOW, MEAN, HIGH)
    digest, out = xxhash.xxh32_intdigest, []
    for t, ends in zip(texts, cuts):
        marks, a = {}, 0
        for b in ends:
            marks[digest(t[a:b])] = b - a
            a = b
        out.append(marks)
    return out


def as_text(marks: Marks) -> str:
    return " ".join(["%08x%02x" % m for m in sorted(marks.items())])


def containment(a: Marks, b: Marks) -> float:
    """Share of a's length in chunks that b has; both empty: 1."""
    if not a:
        return float(not b)
    return sum([n for d, n in a.items() if d in b]) / sum(a.values())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _results(ids: list, texts: list[str], marks: list[Marks]) -> pa.RecordBatch:
    """Rows for all texts but the last, which only follows."""
    new = [edited(t, f) for t, f in zip(texts, texts[1:])]
    raw = [t.encode() for t in new]
    other = chunk_marks(raw)
    n = len(new)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:n], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
            pa.array([as_text(m) for m in marks[:n]], pa.string()),
            pa.array([as_text(m) for m in other], pa.string()),
            pa.array([containment(a, b) for a, b in zip(marks, other)], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(marks, marks[1:])], pa.float64()),
        ],
        names=[c.split()[0] for c in RESULT.split(", ")],
    )


def _stream(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a block come in order, then its head row (tail = 1), the first document of the next block."""
    ids: list = []
    texts: list[str] = []
    marks: list[Marks] = []
    held = 0

    def flush() -> pa.RecordBatch | None:
        marks.extend(chunk_marks([t.encode() for t in texts[len(marks) :]]))
        return _results(ids, texts, marks) if len(texts) > 1 else None

    for batch in batches:
        for doc, text, tail in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("tail").to_pylist()):
            ids.append(doc)
            texts.append(text or "")
            held += len(texts[-1])
            if tail or held >= limit:
                out = flush()
                if out is not None:
                    yield out
                keep = 0 if tail else 1
                ids, texts, marks, held = ids[-1:] * keep, texts[-1:] * keep, marks[-1:] * keep, 0


def fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprint each row of docs(doc_id, text) and its edited text (RESULT's columns).

    Texts are shuffled once, into ranges of doc_id. The ranges' limits, and each range's first id, are one number for
    each partition; the first documents of ranges are sent along to the range before.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    block, blocks = range_block(docs, "doc_id", F.col("tie"), blocks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = docs.select(block.alias("block"), "doc_id", "text", "tie", F.lit(0).alias("tail"))
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")).alias("first")
    firsts = placed.select("block", "doc_id", "tie").groupBy("block").agg(first).select("block", "first.doc_id", "first.tie").orderBy("block").collect()
    if not firsts:
        return placed.select("doc_id", "text", "tail").mapInArrow(_stream, RESULT)
    before = [(firsts[k - 1]["block"], firsts[k]["doc_id"], firsts[k]["tie"]) for k in range(len(firsts))]
    named = spark.createDataFrame(before, "block int, doc_id bigint, tie bigint")  # a row for each block
    alike = docs["doc_id"].eqNullSafe(named["doc_id"]) & (docs["tie"] == named["tie"])
    heads = docs.join(F.broadcast(named), alike).groupBy("block", named["doc_id"], named["tie"]).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = placed.unionByName(heads.select("block", "doc_id", "text", "tie", F.lit(1).alias("tail")))
    dealt = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.select("doc_id", "text", "tail").mapInArrow(_stream, RESULT)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))

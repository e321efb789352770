"""Token-id output: concatenated ids with Elias-Fano coded document boundaries.

File format: a table of segments in Parquet, so that any store Spark reads will do and a lost task's segment is
written anew. A segment holds a run of documents in ascending doc_id order:

    part, seq       its place: range partition, and number within it
    first           ids of the partition before this segment
    n_docs, n_ids   documents and ids in it
    ids             n_ids little-endian ids, `width` bytes each
    ends            Elias-Fano sequence of the documents' ends: width of the low bits, packed low bits, unary coded high
                    bits, and for each 64th set bit of these its position (32 bits), for select
    unnamed         how many documents, the first ones, have no doc_id
    base, names     least doc_id, and an Elias-Fano sequence of what the others exceed it by

Null and empty texts have the end id alone. Rows with equal doc_id keep their own entries, ordered by a digest of
their texts; null doc_ids come first and are read back as null. An empty table gives no segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.bpe import default_tokenizer, encoder
from stemma.llm.common import byte_view, documents, range_block, saved, slices

SEGMENT_IDS = 1 << 21
#: Pieces of words whose ids a worker keeps.
CACHED_PIECES = 1_000_000
HINT = 64
EF = "struct<low_bits:int,low:binary,high:binary,hints:binary>"
SEGMENT = f"part int, seq int, first bigint, n_docs int, n_ids bigint, width int, ids binary, ends {EF}, unnamed int, base bigint, names {EF}"
_EF = pa.struct([("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("hints", pa.binary())])
_SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", _EF), ("unnamed", pa.int32()), ("base", pa.int64()), ("names", _EF)])


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(largest / n) bits an entry."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, hints: bytes):
        self.low_bits, self.low, self.high, self.hints = low_bits, low, high, hints
        self.places = np.frombuffer(hints, "<u4").tolist()

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n = len(v)
        low_bits = max(0, (max(1, int(v[-1])) // n).bit_length() - 1) if n else 0
        low = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        pack = lambda b: np.packbits(b.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(low_bits, pack(low), pack(bits), ones[::HINT].astype("<u4").tobytes())

    def fields(self) -> dict:
        return {"low_bits": self.low_bits, "low": self.low, "high": self.high, "hints": self.hints}

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        raw = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8 + 1], "little")
        return raw >> (a % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest hint, skip whole bytes by their number of set bits."""
        at = self.places[i // HINT]
        left = i % HINT
        byte = at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while left >= (c := word.bit_count()):
            left, byte = left - c, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        return (at - i) << self.low_bits | self._low(i)


def token_rows(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """(block, doc_id, tie, ids) with the end id appended."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, CACHED_PIECES)
        end = np.array([end_id], enc.kind).tobytes()
        for whole in batches:
            for batch in slices(whole, limit=4 << 20):
                ids = [x + end for x in enc.plain(*byte_view(batch.column("text")))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "doc_id", "tie")), pa.array(ids, pa.binary())], names=["block", "doc_id", "tie", "ids"])

    return docs.select("block", "doc_id", "tie", "text").mapInArrow(run, "block int, doc_id bigint, tie bigint, ids binary")


def write_segments(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode docs(doc_id, text), write the segment table into the shared folder and return it."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, width = TaskContext.get().partitionId(), encoder(path, CACHED_PIECES).kind.itemsize
        names, blobs, held, first, seq, unnamed = [], [], 0, 0, 0, 0

        def segment():
            ends = np.cumsum([len(x) // width for x in blobs])
            named = np.array(names[unnamed:], np.int64)
            base = int(named[0]) if len(named) else 0
            row = {"part": part, "seq": seq, "first": first, "n_docs": len(blobs), "n_ids": int(ends[-1]), "width": width, "ids": b"".join(blobs), "ends": EliasFano.of(ends).fields()}
            row |= {"unnamed": unnamed, "base": base, "names": EliasFano.of(named.astype(np.uint64) - np.int64(base).astype(np.uint64)).fields()}
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                names.append(doc)
                unnamed += doc is None
                blobs.append(ids)
                held += len(ids) // width
                if held >= segment_ids:
                    yield segment()
                    names, blobs, held, first, seq, unnamed = [], [], 0, first + held, seq + 1, 0
        if blobs:
            yield segment()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    block, n = range_block(docs, "doc_id", F.col("tie"), n)
    rows = token_rows(docs.withColumn("block", block), tokenizer, end_id)
    ordered = rows.repartitionById(n, F.col("block")).sortWithinPartitions("block", "doc_id", "tie").select("doc_id", "ids")
    return saved(ordered.mapInArrow(run, SEGMENT), "segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document, from the segment table alone."""
    # one row for each range partition, however large the segments are: small enough to send to all
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("total"))
    from pyspark.sql import Window

    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                at, names = EliasFano(**s["ends"]), EliasFano(**s["names"])
                ends = [at.select(i) for i in range(s["n_docs"])]
                starts = [0, *ends[:-1]]
                ids = np.frombuffer(s["ids"], f"<u{s['width']}")
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                docs = [None] * s["unnamed"] + [s["base"] + names.select(i) for i in range(s["n_docs"] - s["unnamed"])]
                start = np.array(starts) + (s["first"] + s["before"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start), pa.array(np.diff(starts, append=ends[-1])), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    columns = ["part", "first", "n_docs", "width", "ids", "ends", "unnamed", "base", "names"]
    return segments.select(*columns).join(F.broadcast(base), "part").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_segments(write_segments(documents(spark, sf_dir)))

"""What the training-data operators share: written intermediate tables, Arrow byte views, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and is a single process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="stemma-"))
    return _own_dir[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that its lineage ends in files any executor can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind value once and use it many times in body, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def row_keys() -> tuple[Column, Column]:
    """Two numbers that are equal for rows(doc_id, text) that agree in both, and for no others."""
    doc = F.col("doc_id").cast("long")
    return F.coalesce(doc, F.lit(0).cast("long")), F.xxhash64(doc.isNull(), F.col("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (UTF-8) or binaries in one array, and n + 1 offsets. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20):
    """Cut a record batch so that each slice holds about `limit` bytes of text, or one row."""
    _, offsets = byte_view(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of `edges`, by alternating large-star and small-star steps.

    Each step is a grouped minimum (combined before its shuffle) and a join that Spark may split where a node is
    hot; no node's neighbours are ever gathered. Component is the smallest node. Null ends and loops are left out. Steps are
    taken until nothing changes; if `rounds` of them do not do, that is an error.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    e = saved(e, "edges")
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = saved(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    pairs = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs, so that phases do not add up on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def range_block(df: DataFrame, column: str, tie: Column, blocks: int) -> tuple[Column, int]:
    """(number of the range that a row falls in, how many there are): ascending by a whole number, null first, then by tie.

    The limits are approximate quantiles, one number a range. A row is placed by two steps of about sqrt(blocks)
    comparisons, without the sampling run over whole rows that range partitioning makes. A value, or null, that has as
    many rows as several ranges gets so many, among which its rows are dealt by tie, a 64-bit hash, in ascending order.
    """
    if blocks < 2:
        return F.lit(0), 1
    limits, nulls, n = df.select(F.percentile_approx(column, [k / blocks for k in range(1, blocks)], 10 * blocks), F.sum(F.col(column).isNull().cast("long")), F.count("*")).first()
    limits, ahead = sorted(limits or []), round(blocks * (nulls or 0) / max(1, n))
    part = lambda k: F.least(k - 1, F.floor((F.shiftright(tie, 1).cast("double") / 2.0**63 + 0.5) * k)).cast("int")
    unnamed = part(F.lit(ahead)) if ahead > 1 else F.lit(0)
    if not limits:
        return unnamed, max(1, ahead)
    width = max(1, int(len(limits) ** 0.5))
    coarse, fine = (F.array(*[F.lit(x) for x in v]).cast("array<bigint>") for v in (limits[::width], limits))

    def passed(under) -> Column:
        steps = F.size(F.filter(coarse, under))
        within = F.slice(fine, (F.greatest(steps, F.lit(1)) - 1) * width + 1, width)
        return F.when(steps == 0, 0).otherwise((steps - 1) * width + F.size(F.filter(within, under)))

    placed = passed(lambda x: x <= F.col(column))
    if len(set(limits)) < len(limits):
        alike = placed - passed(lambda x: x < F.col(column))
        placed = F.when(alike > 1, placed - alike + 1 + part(alike)).otherwise(placed)
    return F.when(F.col(column).isNull(), unnamed).otherwise(placed + ahead).cast("int"), len(limits) + 1 + ahead

"""Near-duplicate detection by SetSketch registers.

A document's set holds its distinct word shingles (64-bit hashes; ASCII lower case). A sketch register is the smallest
of the set's exponentially distributed hashes, kept as a truncated exponent of BASE: mergeable by maximum, and equal
for two sets with about their Jaccard similarity. Bands of ROWS registers find candidates; a likelihood estimate over
all registers and both cardinalities drops the hopeless ones; the rest is confirmed on full sets.

Equal sets are first folded into one representative. In each band's bucket all members are compared with one leader, the
one that meets most others, so no group of copies is expanded into its pairs; the links found make components. Sets of
a bucket that still lie in different components are then compared exactly: their elements are put in one order, rare
ones first, and two sets that are similar enough must meet in an element that stands early in both, with enough behind
it in either (`_candidates`). Pairs within one component are never made.

What can be lost: a pair at similarity 0.85 shares none of 32 bands of 4 with probability 6e-11, at 0.8 with 5e-8, and
an estimate is too low by SLACK for about one pair in 1e9. Nothing else is: what follows the bands is exact.

Null and empty texts have an empty set and are linked with nothing. Texts of fewer words than a shingle have their
whole sequence as one. Repeated rows are copies of each other; rows that share a doc_id but not their text are told
apart. A row without doc_id is linked as any other, but gives no component its id: a component without any doc_id has
a null id, and its rows are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.common import WORD, byte_view, connected_components, documents, row_keys, saved, slices, unused
from stemma.llm.words import mix, span_hashes, word_spans

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.02, 20.0, 2000
#: Candidates whose estimate is below the threshold by more than this are dropped (six standard errors).
SLACK = 0.2
#: Up to so many ids of wanted sets are sent to all executors.
SENT_IDS = 50_000

_rng = np.random.Generator(np.random.PCG64(97))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MULT = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in ASCII lower case, and n + 1 offsets of texts into them."""
    begin, last, at = word_spans(data, offsets)
    return span_hashes(_BYTE[_LOWER[data]], begin, last, _BASE), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = word_hashes(data, offsets)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j : n - width + 1 + j] * _PLACE[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of non-empty sets, one row each."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        x = flat * _MULT[i]
        least[:, i] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
    exp = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exp) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches, given both sets' sizes, over a grid."""
    u, v = n / (n + m), m / (n + m)
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, found = np.full(len(n), -np.inf), np.zeros(len(n))
    for share in np.linspace(0, 1, 51):
        j = share * np.minimum(u / v, v / u)
        up, down = p(u - v * j), p(v - u * j)
        like = above * np.log(up) + below * np.log(down) + same * np.log(np.maximum(1e-12, 1 - up - down))
        found = np.where(like > best, j, found)
        best = np.maximum(best, like)
    return found


def _band_hashes(k: np.ndarray) -> np.ndarray:
    bands = k.reshape(len(k), BANDS, ROWS).astype(np.uint64)
    h = (bands * _PLACE[:ROWS]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[ROWS]
    return mix(h).view(np.int64)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, its row's keys, n_shingles, two digests of the set and its sketch for each row of docs; empty sets have no sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(*byte_view(batch.column("text")), width)
                n = [len(s) for s in sets]
                full = [s for s in sets if len(s)]
                k = iter(sketches(full)) if full else iter(())
                digest = lambda c: pa.array([int(mix(s + np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64()), digest(11), digest(1 << 40), pa.array([next(k).tobytes() if c else None for c in n], pa.binary())],
                    names=["doc_id", "k1", "k2", "n_shingles", "d1", "d2", "sketch"],
                )

    k1, k2 = row_keys()
    rows = docs.select(F.col("doc_id").cast("long"), k1.alias("k1"), k2.alias("k2"), "text")
    return rows.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, d1 bigint, d2 bigint, sketch binary")


def banded(reps: DataFrame) -> DataFrame:
    """(band, rep, n) for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS)
            rep, n = (np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("rep", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(_band_hashes(k).ravel()), pa.array(rep), pa.array(n)], names=["band", "rep", "n"])

    return reps.select("rep", "n", "sketch").mapInArrow(run, "band bigint, rep bigint, n bigint")


def _hopeful(pairs: DataFrame, reps: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) whose estimate reaches floor."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k, m = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS) for c in ("k_a", "k_b"))
                est = estimate(k, m, batch.column("n_a").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float))
                yield batch.select(["a", "b"]).filter(pa.array(est >= floor))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "k_a", "n_b", "k_b").mapInArrow(run, "a bigint, b bigint")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("items").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b")):
                both = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)]))
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(rep, items) with the full set of each wanted representative (rep, k1, k2), from the row that its keys name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                items = [s.tobytes() for s in shingle_sets(*byte_view(batch.column("text")), width)]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(items, pa.binary())], names=["rep", "items"])

    reps = F.broadcast(reps) if reps.limit(SENT_IDS + 1).count() <= SENT_IDS else reps.hint("merge")
    k1, k2 = row_keys()
    found = docs.select(k1.alias("k1"), k2.alias("k2"), "text").join(reps, ["k1", "k2"]).select("rep", "text")
    return found.mapInArrow(run, "rep bigint, items binary").groupBy("rep").agg(F.first("items").alias("items"))


def _elements(sets: DataFrame) -> DataFrame:
    """(rep, h): one row for each element of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, "items", 4 << 20):
                h, offsets = byte_view(one.column("items"))
                at = pa.array(np.repeat(np.arange(one.num_rows), np.diff(offsets) // 8))
                yield pa.RecordBatch.from_arrays([one.column("rep").take(at), pa.array(np.frombuffer(h.tobytes(), np.int64))], names=["rep", "h"])

    return sets.select("rep", "items").mapInArrow(run, "rep bigint, h bigint")


def _candidates(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets (rep, n, c) in different components c that hold all links between components.

    Elements are ordered by how many of the sets hold them, then by hash. For two sets x and y, the first element they
    share has all shared ones at or behind it in both, so their intersection is at most the lesser of n - at, at
    being its place. A link needs percent * (n_x + n_y) / (100 + percent), and of any partner at least percent / 100 of n.

    For each element, sets of its commonest component stand apart: a pair needs one set from outside it. What they have
    in common is their (n, at) alone, so it is first decided which (n, at) can meet, and only those rows are joined.
    """
    elements = _elements(sets.join(open_.select("rep"), "rep"))
    held = elements.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    order = Window.partitionBy("rep").orderBy("f", "h")
    ranked = elements.join(held, "h").withColumn("at", F.row_number().over(order)).withColumn("common", F.count("*").over(Window.partitionBy("rep")))
    # elements that no other set holds come first and need no rows
    ranked = ranked.join(open_, "rep").withColumn("at", (F.col("n") - F.col("common") + F.col("at") - 1).cast("long"))
    early = saved(ranked.where(100 * (F.col("n") - F.col("at")) >= percent * F.col("n")).select("h", "rep", "c", "n", "at"), "early")
    usual = early.groupBy("h", "c").agg(F.count("*").alias("m")).groupBy("h").agg(F.max(F.struct("m", "c")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    rows = saved(early.join(usual.select("h", F.col("most.c").alias("main")), "h").withColumn("other", F.col("c") != F.col("main")).drop("main"), "meeting")
    cells = saved(rows.groupBy("h", "n", "at").agg(F.max("other").alias("other")), "cells")
    enough = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("n_y") - F.col("at_y")) >= percent * (F.col("n") + F.col("n_y"))
    named = lambda df, *names: df.select("h", *[F.col(x).alias(f"{x}_y") for x in names])
    cells = cells.where("other").alias("x").join(named(cells, "n", "at").alias("y"), (F.col("x.h") == F.col("y.h")) & enough).select("x.h", "n", "at", "n_y", "at_y")
    met = rows.where("other").join(cells, ["h", "n", "at"]).alias("x").join(named(rows, "n", "at", "rep", "c").alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("h", "n_y", "at_y")] + [F.col("c") != F.col("c_y")])
    return met.select(F.least("rep", "rep_y").alias("a"), F.greatest("rep", "rep_y").alias("b")).distinct()


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row keys, n_shingles and top for each row of docs; top is the component's first row by id (unnamed, k1, k2)."""
    every = saved(sketched(docs, width), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "k1", "k2")
    folded = every.where("n_shingles > 0").groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min(row).alias("row"), F.first("sketch").alias("sketch"))
    reps = saved(folded.withColumn("rep", F.monotonically_increasing_id()), "sets")
    bands = banded(reps)
    sizes = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    buckets = saved(bands.join(sizes, "band").select("band", "rep", "members"), "buckets")
    weight = buckets.groupBy("rep").agg(F.sum("members").alias("weight"))
    leaders = buckets.join(weight, "rep").groupBy("band").agg(F.max(F.struct("weight", -F.col("rep"))).alias("top")).select("band", (-F.col("top.col2")).alias("leader"))
    led = buckets.join(leaders, "band").where("rep <> leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b"))
    floor = percent / 100 - SLACK
    pairs = saved(_hopeful(led.distinct(), reps, floor), "hopeful")
    wanted = reps.join(buckets.select("rep").distinct(), "rep").select("rep", "row.k1", "row.k2")
    sets = saved(_sets(docs, saved(wanted, "wanted"), width), "items")
    links = saved(_links(pairs, sets, percent), "links")
    found = connected_components(links)
    named = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("c"))
    apart = named.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2")
    open_ = named.join(apart.select("band"), "band").groupBy("rep").agg(F.first("c").alias("c"))
    open_ = saved(open_.join(reps.select("rep", "n"), "rep"), "open")
    more = _candidates(open_, sets, percent) if not open_.isEmpty() else pairs.limit(0)
    more = more.join(pairs, ["a", "b"], "left_anti")
    more = saved(_links(saved(_hopeful(more, reps, floor), "hopeful"), sets, percent), "links")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))
    near = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    first = near.where("component is not null").groupBy("component").agg(F.min("row").alias("first"))
    tops = near.join(first, "component", "left").select("d1", "d2", F.col("n").alias("n_shingles"), F.coalesce("first", "row").alias("top"))
    return every.join(tops, ["d1", "d2", "n_shingles"], "left").select("doc_id", "k1", "k2", "n_shingles", "top")


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text)."""
    top = F.col("top")
    component = F.when(top.isNull(), F.col("doc_id")).when(~top["unnamed"], top["k1"])
    out = _grouped(docs, width, percent).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each group, the one with the least doc_id; rows without a word all stay."""
    top = F.col("top")
    keep = _grouped(docs, width, percent).where((top["k1"] == F.col("k1")) & (top["k2"] == F.col("k2"))).select("k1", "k2").distinct()
    a, b = unused(docs, "_k1", "_k2")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    k1, k2 = row_keys()
    # repeated rows are folded before their texts are moved, so that many of one row do not meet in one task
    rows = docs.where(worded).withColumns({a: k1, b: k2}).dropDuplicates([a, b])
    rows = rows.join(keep.select(F.col("k1").alias(a), F.col("k2").alias(b)), [a, b], "left_semi")
    return rows.select(*docs.columns).unionByName(docs.where(~worded))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir), width=3, percent=85)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[]
         WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) END AS items
  FROM w
), n AS (
  SELECT doc_id, len(items)::BIGINT AS n_shingles FROM s
), x AS (
  SELECT doc_id, unnest(items) AS item FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM x a JOIN x b ON a.item = b.item AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles
  HAVING 100 * count(*) >= 85 * (na.n_shingles + nb.n_shingles - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM n
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
), comp AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN comp c ON c.node = n.doc_id
"""

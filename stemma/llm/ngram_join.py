"""Join of documents whose n-gram sets have a high Jaccard similarity, by vertical partitioning.

Grams stand in one global order, rare ones first: by the number of sets that hold them, then by hash. The order is cut
into FRAGMENTS at quantiles, and each set into one segment for each fragment. The overlap of a pair is counted apart in
each fragment that both have grams in, and the counts are summed for each pair; the sum decides on the link.

Which pairs are counted. Two sets with intersection >= percent / 100 of the union share the first gram that they have
in common early in both: not more than n - percent / 100 * n grams of either stand before it. Four steps use that:

1. `_crowded`: grams are hashed and dealt out by hash; a gram that occurs once in a batch of texts and in no other batch
   is in one set only. A set whose share of other grams is below percent / 100 links with nothing and goes out. Each
   batch sends a gram once, so a passage in a third of all documents comes once for each batch.
2. Grams of the sets that stay are put in order, and each set keeps the early ones (its prefix).
3. `_led`: the sets that hold an early gram are compared with one of them, the one that meets most others. Links make
   components, so the copies of one text are never paired among themselves.
4. `_apart`: sets of different components that still share an early gram are paired where their sizes and the gram's
   place in both allow a link. It is exact: no link between different components is lost, and links within one do not
   change it.

Equal sets are one set throughout. Grams are 64-bit hashes of ASCII lower-case words. Null and empty texts and those
without a word have an empty set and are linked with nothing; texts of fewer words than a gram have their whole sequence
as one. Repeated rows are copies; rows that share a doc_id but not their text are told apart; rows without doc_id are
linked as any other but give no component its id (a component without any doc_id has a null one). A very long text is
hashed in one task, as one cell. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.common import byte_view, connected_components, documents, row_keys, saved, slices
from stemma.llm.near_dedup import OP9_SQL, shingle_sets
from stemma.llm.words import mix

FRAGMENTS = 16
#: Bytes of text whose grams meet in one task when occurrences are counted.
COUNTED_BYTES = 8 << 20
#: Grams of texts that are told apart by batch, and most rows in a batch.
BATCH_GRAMS, BATCH_ROWS = 1 << 19, 50_000
#: Up to so many row keys are sent to all executors.
SENT_KEYS = 50_000


def _gram_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows (without their texts) and gram sets, in batches of about BATCH_GRAMS."""
    rows, sets, n = [], [], 0
    for whole in batches:
        for batch in slices(whole):
            found = shingle_sets(*byte_view(batch.column("text")), width)
            rows.append(batch.select([c for c in batch.schema.names if c != "text"]))
            sets += found
            n += sum(map(len, found))
            if n >= BATCH_GRAMS or len(sets) >= BATCH_ROWS:
                yield pa.Table.from_batches(rows), sets
                rows, sets, n = [], [], 0
    if sets:
        yield pa.Table.from_batches(rows), sets


_DEALT = "part int, doc_id bigint, k1 bigint, k2 bigint, n bigint, d1 bigint, d2 bigint, batch bigint, row int, shared bigint, grams binary"


def _dealt(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """Two kinds of rows: one for each document, and for each batch and part the grams that fall there.

    A document tells its set's size and digests, and how many of its grams other documents of its batch hold. A gram is five bytes
    of its hash; those of one document alone are followed by its row in the batch, those of several stand apart behind them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 32
        for rows, sets in _gram_batches(batches, width):
            n = np.array([len(s) for s in sets])
            h, row = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            alone = first & np.concatenate([first[1:], [True]]) if len(h) else first
            shared = np.bincount(row[~alone], minlength=len(sets))
            digest = lambda c: pa.array([int(mix(s + np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64())
            none = lambda kind, m: pa.nulls(m, kind)
            m = len(sets)
            columns = [pa.array((np.arange(m) + batch_id) % parts, pa.int32()), *[rows.column(c).combine_chunks() for c in ("doc_id", "k1", "k2")], pa.array(n), digest(11), digest(1 << 40), pa.array(np.full(m, batch_id)), pa.array(np.arange(m), pa.int32()), pa.array(shared), none(pa.binary(), m)]
            names = [c.split()[0] for c in _DEALT.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            h, row, alone = h[first], row[first], alone[first]
            part = ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            h, row, alone, part = h[order], row[order], alone[order], part[order]
            where, start = np.unique(part, return_index=True)
            blobs = []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(part)]):
                one = alone[a:b]
                x = np.concatenate([h[a:b][one], h[a:b][~one]])
                head = np.array([one.sum(), len(x)], np.uint32).tobytes()
                blobs.append(head + (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((x >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes() + row[a:b][one].tobytes())
            m = len(where)
            columns = [pa.array(where, pa.int32()), *[none(pa.int64(), m)] * 6, pa.array(np.full(m, batch_id)), none(pa.int32(), m), none(pa.int64(), m), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            batch_id += 1
            del columns, blobs, sets, h, row, order
            pa.default_memory_pool().release_unused()

    k1, k2 = row_keys()
    rows = docs.select(F.col("doc_id").cast("long"), k1.alias("k1"), k2.alias("k2"), "text")
    return rows.mapInArrow(run, _DEALT)


def _met(dealt: DataFrame, parts: int) -> DataFrame:
    """The rows of documents, and for each batch and part how many of its documents' lone grams other batches hold.

    Such a row has the number of documents in `row`, and in `grams` their rows (two bytes each) and counts (four).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, memoryview]]] = {}
        for batch in batches:
            yield batch.filter(batch.column("grams").is_null())
            for part, batch_id, grams in zip(*(batch.column(c).to_pylist() for c in ("part", "batch", "grams"))):
                if grams is not None:
                    held.setdefault(part, []).append((batch_id, memoryview(grams)))
        schema = batch.schema if held else None
        for part in list(held):
            hashes, ids, rows = [], [], []
            for batch_id, raw in held.pop(part):
                one, n = np.frombuffer(raw, np.uint32, 2).tolist()
                low, high = np.frombuffer(raw, np.uint32, n, 8), np.frombuffer(raw, np.uint8, n, 8 + 4 * n)
                hashes.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
                ids.append(np.full(n, len(ids), np.int32))
                row = np.full(n, -1, np.int32)
                row[:one] = np.frombuffer(raw[8 + 5 * n :].tobytes(), np.uint16, one)
                rows.append((batch_id, row))
            h, which = np.concatenate(hashes), np.concatenate(ids)
            row = np.concatenate([r for _, r in rows])
            del hashes, ids
            order = np.argsort(h, kind="stable")
            h = h[order]
            same = h[1:] == h[:-1]
            again = np.zeros(len(h), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            again &= row >= 0
            pair, count = np.unique(which[again].astype(np.int64) << 16 | row[again], return_counts=True)
            at = np.searchsorted(pair, np.arange(len(rows) + 1, dtype=np.int64) << 16).tolist()
            full = [i for i in range(len(rows)) if at[i] < at[i + 1]]
            blobs = [(pair[at[i] : at[i + 1]] & 0xFFFF).astype(np.uint16).tobytes() + count[at[i] : at[i + 1]].astype(np.uint32).tobytes() for i in full]
            told = {"batch": pa.array([rows[i][0] for i in full], pa.int64()), "row": pa.array([at[i + 1] - at[i] for i in full], pa.int32()), "grams": pa.array(blobs, pa.binary())}
            yield pa.RecordBatch.from_arrays([told.get(f.name, pa.nulls(len(full), f.type)) for f in schema], schema=schema)

    return dealt.repartition(parts, "part").mapInArrow(run, _DEALT)


def _opened(met: DataFrame, parts: int, percent: int) -> DataFrame:
    """(doc_id, k1, k2, n, d1, d2, open) for each document; open ones have enough grams that others hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs = {}, []
        for batch in batches:
            own = batch.column("grams").is_null()
            docs.append(batch.filter(own).select(["doc_id", "k1", "k2", "n", "d1", "d2", "batch", "row", "shared"]))
            rest = batch.filter(pa.compute.invert(own))
            for batch_id, m, raw in zip(*(rest.column(c).to_pylist() for c in ("batch", "row", "grams"))):
                total = found.setdefault(batch_id, np.zeros(1 << 16, np.int64))
                total[np.frombuffer(raw, np.uint16, m)] += np.frombuffer(raw, np.uint8, 4 * m, 2 * m).copy().view(np.uint32)
        for batch in docs:
            shared = batch.column("shared").to_numpy().copy()
            batch_id, row = batch.column("batch").to_numpy(), batch.column("row").to_numpy()
            for i in np.unique(batch_id).tolist():
                if i in found:
                    shared[batch_id == i] += found[i][row[batch_id == i]]
            told = pa.array(100 * shared >= percent * batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], told], names=[*batch.schema.names[:6], "open"])

    return met.repartition(parts, "batch").mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, n bigint, d1 bigint, d2 bigint, open boolean")


def _crowded(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows of docs with keys, size and digests of their sets; sets (rep, n, k1, k2) that may link)."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    parts = max(8, -(-size // COUNTED_BYTES))
    every = saved(_opened(_met(_dealt(docs, width, parts), parts), parts, percent), "opened")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "k1", "k2")
    sets = every.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(row).alias("row"), F.max("open").alias("open")).where("open")
    sets = saved(sets.select(F.monotonically_increasing_id().alias("rep"), "n", "d1", "d2", "row"), "sets")
    return every.select("doc_id", "k1", "k2", "n", "d1", "d2"), sets


def _grams(docs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(rep, h): the grams of the given sets, each from the text its row's keys name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = shingle_sets(*byte_view(batch.column("text")), width)
                at = pa.array(np.repeat(np.arange(len(found)), [len(s) for s in found]))
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(at), pa.array(np.concatenate(found).view(np.int64))], names=["rep", "h"])

    keys = sets.select("rep", "row.k1", "row.k2")
    keys = F.broadcast(keys) if keys.limit(SENT_KEYS + 1).count() <= SENT_KEYS else keys
    k1, k2 = row_keys()
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), "text").join(keys, ["k1", "k2"])
    # a row that is repeated gives its set once; its copies are told apart by nothing, so equal grams are folded
    return texts.select("rep", "text").dropDuplicates(["rep"]).mapInArrow(run, "rep bigint, h bigint")


def _ordered(grams: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, n, h, place, at) of grams that two sets hold or more: their place in the global order, and in their set.

    The place grows with the number of sets that hold a gram, then with its hash; equal places are told apart by h.
    """
    held = grams.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    place = F.col("f") + (F.shiftright("h", 32).cast("double") + 2.0**31) / 2.0**32
    ranked = grams.join(held.select("h", place.alias("place")), "h")
    own = Window.partitionBy("rep")
    # grams that no other set holds come first and need no rows
    ranked = ranked.withColumns({"i": F.row_number().over(own.orderBy("place", "h")), "common": F.count("*").over(own.orderBy("place", "h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return ranked.join(sets.select("rep", "n"), "rep").select("rep", "n", "h", "place", (F.col("n") - F.col("common") + F.col("i") - 1).alias("at"))


def segments(ordered: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """(rep, fragment, grams): the global order cut at quantiles, and each set's grams in each fragment."""
    cuts = sorted(set(ordered.agg(F.percentile_approx("place", [k / fragments for k in range(1, fragments)], 10 * fragments)).first()[0] or []))
    fragment = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col("place")))
    return ordered.groupBy("rep", fragment.alias("fragment")).agg(F.collect_list("h").alias("grams"))


def _fits(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sets of these sizes may link."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def linked(pairs: DataFrame, cut: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps are counted fragment by fragment and summed for each pair."""
    side = lambda x: cut.select(F.col("rep").alias(x), "fragment", F.col("grams").alias(f"grams_{x}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), ["a", "fragment"])
    counted = both.select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).cast("bigint").alias("shared")).where("shared > 0")
    total = counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    size = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"))
    whole = total.join(size("a"), "a").join(size("b"), "b")
    return whole.where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _led(early: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each early gram's sets with one of them, the one that meets most others."""
    crowd = early.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    weight = early.join(crowd, "h").groupBy("rep").agg(F.sum("m").alias("weight"))
    leader = early.join(weight, "rep").groupBy("h").agg(F.max(F.struct("weight", "rep", "n")).alias("s")).select("h", F.col("s.rep").alias("leader"), F.col("s.n").alias("n_l"))
    met = early.join(leader, "h").where((F.col("rep") != F.col("leader")) & _fits(F.col("n"), F.col("n_l"), percent))
    return met.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def _apart(early: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that hold all links between components.

    The first gram that two sets share has all shared ones at or behind it in both, so their intersection is at most the
    lesser of n - at, and a link needs percent * (n + n) / (100 + percent). For each gram, sets of its commonest component
    stand apart: a pair needs one set from outside it. What sets have in common there is their (n, at), so it is first
    decided which (n, at) can meet, and only their rows are joined.
    """
    named = early.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    usual = named.groupBy("h", "c").agg(F.count("*").alias("m")).groupBy("h").agg(F.max(F.struct("m", "c")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    rows = saved(named.join(usual.select("h", F.col("most.c").alias("main")), "h").withColumn("other", F.col("c") != F.col("main")).select("h", "rep", "c", "n", "at", "other"), "meeting")
    cells = saved(rows.groupBy("h", "n", "at").agg(F.max("other").alias("other")), "cells")
    enough = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("n_y") - F.col("at_y")) >= percent * (F.col("n") + F.col("n_y"))
    second = lambda df, *names: df.select("h", *[F.col(x).alias(f"{x}_y") for x in names])
    cells = cells.where("other").join(second(cells, "n", "at"), "h").where(enough).select("h", "n", "at", "n_y", "at_y")
    met = rows.where("other").join(cells, ["h", "n", "at"]).join(second(rows, "n", "at", "rep", "c"), ["h", "n_y", "at_y"]).where("c <> c_y")
    return met.select(F.least("rep", "rep_y").alias("a"), F.greatest("rep", "rep_y").alias("b")).distinct()


def joined(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs(doc_id, text); components are those of the links' graph."""
    every, sets = _crowded(docs, width, percent)
    ordered = saved(_ordered(_grams(docs, sets, width), sets), "ordered")
    early = saved(ordered.where(100 * (F.col("n") - F.col("at")) >= percent * F.col("n")).select("h", "rep", "n", "at"), "early")
    # only sets with an early gram that another set has early too can link
    wanted = early.select("rep").distinct()
    cut = saved(segments(ordered.join(wanted, "rep", "left_semi")), "segments")
    pairs = saved(_led(early, percent), "led")
    links = saved(linked(pairs, cut, sets, percent), "links")
    found = connected_components(links)
    more = saved(_apart(early, found, percent).join(pairs, ["a", "b"], "left_anti"), "apart")
    more = saved(linked(more, cut, sets, percent), "links")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))
    near = sets.join(found.withColumnRenamed("node", "rep"), "rep")
    least = near.groupBy("component").agg(F.min("row").alias("top"))
    near = near.join(least, "component").select("d1", "d2", "n", "top")
    # equal sets are linked with each other, whether or not with others
    alike = every.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "k1", "k2")).alias("own"))
    tops = alike.join(near, ["d1", "d2", "n"], "left").select("d1", "d2", "n", F.coalesce("top", "own").alias("top"))
    out = every.join(tops, ["d1", "d2", "n"], "left")
    component = F.when(F.col("top").isNull(), F.col("doc_id")).when(~F.col("top.unnamed"), F.col("top.k1"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir), width=4, percent=85)


OP11_SQL = (
    OP9_SQL.replace("len(words) < 3", "len(words) < 4")
    .replace("words[i + 2] FOR i IN range(1, len(words) - 1)", "words[i + 2] || ' ' || words[i + 3] FOR i IN range(1, len(words) - 2)")
    .replace(", n.doc_id = c.component_id AS kept", "")
)

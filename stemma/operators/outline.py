"""Tree operators on outlines: rows form a tree by level and order only.

A row's parent is the nearest earlier row of a smaller level, and its subtree ends at the first later row that is not
deeper. Both come from one pass with a stack over each part (a batch file or any range of rows). What a part leaves open
is short whatever its length: the rows without a parent in it, one for each level they have, and its last stack. These
rows of neighbouring parts are put one behind the other, FAN parts at a time, and go through the same pass; what is
then still open goes through a last one. So neither a window nor a task holds a row for each part, and there is no
limit on levels. Counts and next rows are carried by windows over FAN parts and over groups of FAN parts.

Frames have `pos` (any ordered type), `level`, and a part column whose order agrees with `pos`; `group` columns, if
given, separate outlines (books, queries). Parts of another type than whole numbers, such as file names, are ranked first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.sources.scratch import written

#: Parts in a group of parts, as a power of two.
FAN_BITS = 10


def _depth() -> Column:
    return F.greatest(F.col("level"), F.lit(0))


def _group_of(part: Column) -> Column:
    return F.shiftright(part.cast("bigint"), FAN_BITS)


def _joined(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", on: tuple[str, ...] = ()) -> DataFrame:
    """df with the other columns of `other`, whose `keys` equal (null too) those of df; `on` names df's columns for them."""
    s = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    cond = [df[k].eqNullSafe(s[f"_k{i}"]) for i, k in enumerate(on or keys)]
    return df.join(s, cond or F.lit(True), how).drop(*[f"_k{i}" for i in range(len(keys))])


def ranked(df: DataFrame, column: str) -> DataFrame:
    """(column, rank): the distinct values from 1 in their order; windows run over one range of values, and over one row for each range."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = written(df.select(column).distinct().repartitionByRange(ranges, column).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = spread.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    local = spread.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(column)))
    return local.join(ahead, "_range").select(column, (F.col("_before") + F.col("_i")).alias("rank"))


def numbered_part(df: DataFrame, part: str) -> tuple[DataFrame, str]:
    """(df, part) as they are for whole numbers; else df with the part's rank as `_rank`."""
    if isinstance(df.schema[part].dataType, T.IntegralType):
        return df, part
    return df.join(ranked(df, part).withColumnRenamed("rank", "_rank"), part), "_rank"


def with_ordinal(df: DataFrame, part: str, group: tuple[str, ...] = ()) -> DataFrame:
    """df with `ord`, 1 to n in the order of pos within its group, and `n_rows` of the group."""
    columns = [*df.columns, "n_rows", "ord"]
    df, part = numbered_part(df, part)
    keys = [*group, part]
    summary = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_g", _group_of(F.col(part)))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy(*group)
    groups = summary.groupBy(*group, "_g").agg(F.sum("_n").alias("_m"))
    groups = groups.select(*group, "_g", earlier(every.orderBy("_g"), "_m").alias("_ahead"), F.sum("_m").over(every).alias("n_rows"))
    summary = summary.withColumn("_before", earlier(Window.partitionBy(*group, "_g").orderBy(part), "_n")).drop("_n")
    summary = _joined(summary, groups, [*group, "_g"]).drop("_g")
    local = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    return _joined(local, summary, keys).withColumn("ord", F.col("_ahead") + F.col("_before") + F.col("_i")).select(*columns)


def has_children(df: DataFrame, part: str, group: tuple[str, ...] = ()) -> DataFrame:
    """df with has_children: the next row is deeper. The last row has none."""
    columns = [*df.columns, "has_children"]
    df, part = numbered_part(df, part)
    keys = [*group, part]
    summary = df.groupBy(*keys).agg(F.min_by("level", "pos").alias("_first")).withColumn("_g", _group_of(F.col(part)))
    groups = summary.groupBy(*group, "_g").agg(F.min_by("_first", part).alias("_first"))
    groups = groups.select(*group, "_g", F.lead("_first").over(Window.partitionBy(*group).orderBy("_g")).alias("_beyond"))
    summary = summary.withColumn("_next", F.lead("_first").over(Window.partitionBy(*group, "_g").orderBy(part))).drop("_first")
    summary = _joined(summary, groups, [*group, "_g"]).drop("_g")
    local = df.withColumn("_lead", F.lead("level").over(Window.partitionBy(*keys).orderBy("pos")))
    told = F.coalesce(F.coalesce("_lead", "_next", "_beyond") > F.col("level"), F.lit(False))
    return _joined(local, summary, keys).withColumn("has_children", told).select(*columns)


def _pass(df: DataFrame, keys: list[str], want: str) -> DataFrame:
    """df (with pos and _d, its depth) and what one stack over each run of equal keys tells of its rows.

    _up: the nearest earlier row of a smaller depth, or with `chain` all rows on the way up, outermost first, as
    array<struct<l, p>>. _end: the first later row that is not deeper. _first: where the way up leaves the run, the first
    row whose way goes on as this one's. _left: the end lies beyond the run.
    """
    kind = df.schema["pos"].dataType
    up = T.ArrayType(T.StructType([T.StructField("l", T.IntegerType()), T.StructField("p", kind)])) if want == "chain" else kind
    schema = T.StructType([*df.schema.fields, T.StructField("_up", up), T.StructField("_end", kind), T.StructField("_first", kind), T.StructField("_left", T.BooleanType())])

    def told(rows: pa.Table) -> pa.Table:
        depth, run = rows.column("_d").to_numpy(), rows.column("_run").to_numpy()
        starts = np.concatenate([[True], run[1:] != run[:-1]]).tolist()
        n = len(starts)
        above, end, first, left = [-1] * n, [-1] * n, [0] * n, np.zeros(n, bool)
        ways, offsets, stack, depths, top, lowest = [], [0], [], [], 0, -1
        for i, d in enumerate(depth.tolist()):
            if starts[i]:
                left[stack] = True
                stack, depths, lowest = [], [], -1
            while depths and depths[-1] >= d:
                end[stack.pop()] = i
                depths.pop()
            if stack:
                above[i] = stack[-1]
            elif d != lowest:
                top, lowest = i, d
            first[i] = top
            if want == "chain":
                ways += stack
                offsets.append(len(ways))
            stack.append(i)
            depths.append(d)
        left[stack] = True
        pos = rows.column("pos").combine_chunks()
        at = lambda x: pos.take(pa.array(x, pa.int64(), mask=np.array(x) < 0))
        if want == "chain":
            way = pa.array(ways, pa.int64())
            found = pa.StructArray.from_arrays([rows.column("_d").combine_chunks().take(way), pos.take(way)], ["l", "p"])
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)
        else:
            found = at(above)
        return rows.drop_columns(["_run"]).append_column("_up", found).append_column("_end", at(end)).append_column("_first", at(first)).append_column("_left", pa.array(left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last run may go on in the next batch
            ids = batch.column("_run").to_numpy()
            cut = int(np.flatnonzero(ids != ids[-1]).max(initial=-1)) + 1
            if cut or (held and held[-1].column("_run")[-1].as_py() != ids[0]):
                yield from told(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from told(pa.Table.from_batches(held)).to_batches()

    sent = df.withColumn("_run", F.xxhash64(*keys) if keys else F.lit(0).cast("bigint"))
    dealt = sent.repartition(*keys) if keys else sent.repartition(1)
    return dealt.sortWithinPartitions(*keys, "pos").mapInArrow(run, schema)


def _open(told: DataFrame, *columns: str) -> DataFrame:
    """Of a run's rows those that later passes need."""
    return told.where((F.col("_first") == F.col("pos")) | F.col("_left")).select(*columns, "pos", "_d")


def _carried(told: DataFrame, more: DataFrame, group: list[str], want: str) -> DataFrame:
    """told with _up or _end, completed by the rows of `more`, in which nothing is open any longer."""
    if want == "end":
        ends = more.select(*group, "pos", F.col("_end").alias("_beyond"))
        return _joined(told, ends, [*group, "pos"], "left").withColumn("_end", F.coalesce("_end", "_beyond")).drop("_beyond")
    tops = more.select(*group, F.col("pos").alias("_first"), F.col("_up").alias("_beyond"))
    both = F.concat(F.coalesce("_beyond", F.array().cast(more.schema["_up"].dataType)), "_up") if want == "chain" else F.coalesce("_up", "_beyond")
    return _joined(told, tops, [*group, "_first"], "left").withColumn("_up", both).drop("_beyond")


def _scanned(df: DataFrame, part: str, group: tuple[str, ...], want: str) -> DataFrame:
    """df with _up (want `up` or `chain`) or _end (want `end`) over the whole order."""
    keys, columns = list(group), [*df.columns, "_end" if want == "end" else "_up"]
    df, part = numbered_part(df, part)
    told = written(_pass(df.withColumn("_d", _depth().cast("int")), [*keys, part], want), "outline")
    short = _open(told, *keys, part).withColumn("_g", _group_of(F.col(part))).drop(part)
    groups = _pass(short, [*keys, "_g"], want)
    last = _pass(_open(groups, *keys), keys, want)
    full = _carried(groups.drop("_g", "_d"), last, keys, want)
    return _carried(told, full, keys, want).select(*columns)


def with_ancestors(df: DataFrame, part: str, group: tuple[str, ...] = ()) -> DataFrame:
    """df with `ancestors` (positions, outermost first). The way up stops at level 0, whose rows are no ancestors."""
    way = F.transform(F.filter("_up", lambda x: x["l"] > 0), lambda x: x["p"])
    return _scanned(df, part, group, "chain").withColumn("ancestors", way).drop("_up")


def with_parent(df: DataFrame, part: str, group: tuple[str, ...] = ()) -> DataFrame:
    """df with `parent_pos`: the nearest earlier row of a smaller level, level 0 included; negative levels count as 0."""
    return _scanned(df, part, group, "up").withColumnRenamed("_up", "parent_pos")


def with_subtree_end(df: DataFrame, part: str, group: tuple[str, ...] = ()) -> DataFrame:
    """df with ord, n_rows and `end_ord`: ordinal of the first later row that is not deeper, n_rows + 1 if none."""
    numbered = with_ordinal(df, part, group).withColumnRenamed("pos", "_pos").withColumnRenamed("ord", "pos")
    ends = _scanned(numbered, part, group, "end").withColumnRenamed("pos", "ord").withColumnRenamed("_pos", "pos")
    return ends.withColumn("end_ord", F.coalesce("_end", F.col("n_rows") + 1)).drop("_end")


def with_ways(df: DataFrame, part: str) -> DataFrame:
    """df with ord, n_rows and `way`: the ordinals of all rows above, outermost first, a level-0 row included."""
    numbered = with_ordinal(df, part).withColumnRenamed("pos", "_pos").withColumnRenamed("ord", "pos")
    ways = _scanned(numbered, part, (), "chain").withColumnRenamed("pos", "ord").withColumnRenamed("_pos", "pos")
    return ways.withColumn("way", F.transform("_up", lambda x: x["p"])).drop("_up")


def subtree_rows(df: DataFrame, nodes: DataFrame, part: str) -> DataFrame:
    """(node, pos, level, has_children, ...): all rows below each of nodes(node), the node itself left out.

    A row lies below a node if the node is on its way up, or is the level-0 row its way ends at: an equality join.
    """
    rows = _scanned(has_children(df, part), part, (), "chain")
    above = rows.withColumn("node", F.explode(F.transform("_up", lambda x: x["p"]))).drop("_up")
    return above.join(nodes.select("node").distinct(), "node", "left_semi")


def enclosing(df: DataFrame, at: DataFrame, part: str) -> DataFrame:
    """(pos), distinct: the rows whose subtree holds a row of at(pos) or ends at it, those of `at` left out unless they do too.

    These are the row before it and all rows on that one's way up.
    """
    df, part = numbered_part(df.select("pos", "level", part), part)
    numbered = written(with_ordinal(df, part), "ordinals")
    before = numbered.join(at.select("pos").distinct(), "pos").select((F.col("ord") - 1).alias("ord"))
    ways = _scanned(numbered, part, (), "chain").join(before, "ord")
    return ways.select(F.explode(F.concat(F.array("pos"), F.transform("_up", lambda x: x["p"]))).alias("pos")).distinct()

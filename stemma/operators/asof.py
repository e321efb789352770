"""As-of join on a key of any ordered type: for each row the last boundary at or before its key.

Rows and boundaries are dealt out together by ranges of the key, so each task merges one range by a window. What a range
lacks at its front is the last boundary of the ranges before it: a window over one row for each range. Keys may be
skewed: equal keys of rows are looked up once, and equal boundaries are folded first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.sources.scratch import written


def last_before(rows: DataFrame, boundaries: DataFrame, key: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, key, value): for each distinct key of rows the value of the greatest boundary key not above it, within `by`.

    Of boundaries with one key the least value counts. Keys before the first boundary, and null ones, have no row.
    """
    keys = [*by, key]
    asked = rows.select(*keys).where(F.col(key).isNotNull()).distinct().select(*keys, F.lit(1).alias("_kind"), F.lit(None).cast(boundaries.schema[value].dataType).alias("_value"))
    known = boundaries.where(F.col(key).isNotNull()).groupBy(*keys).agg(F.min(value).alias("_value")).select(*keys, F.lit(0).alias("_kind"), "_value")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(known.unionByName(asked).repartitionByRange(ranges, *keys, "_kind").withColumn("_range", F.spark_partition_id()), "asof")
    last = dealt.groupBy("_range").agg(F.max(F.when(F.col("_kind") == 0, F.struct(*keys))).alias("_end"), F.max_by(F.struct(*by, "_value"), F.when(F.col("_kind") == 0, F.struct(*keys))).alias("_last"))
    earlier = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_range", F.last(F.when(F.col("_end").isNotNull(), F.col("_last")), ignorenulls=True).over(earlier).alias("_carried"))
    local = F.last("_value", ignorenulls=True).over(Window.partitionBy("_range", *by).orderBy(key, "_kind"))
    merged = dealt.withColumn("_found", local).where("_kind = 1").join(carried, "_range")
    same = F.lit(True)
    for b in by:
        same = same & F.col(f"_carried.{b}").eqNullSafe(F.col(b))
    found = F.coalesce("_found", F.when(same, F.col("_carried._value")))
    return merged.select(*keys, found.alias(value)).where(F.col(value).isNotNull())

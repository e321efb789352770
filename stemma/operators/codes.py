"""Book pages of codes: exact join on the code, else the last page boundary at or before it.

The code map and the boundaries derived from it are small beside the coded rows. Joins carry no broadcast hint: Spark
broadcasts the map when its size allows, and otherwise shuffles both sides on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import code_key, normalize_code
from stemma.operators.asof import last_before
from stemma.sources.scratch import written

TOP = 10
#: The row type of an as-of hit; maps do not use it.
BOUNDARY = "page_boundary"


def keyed(rows: DataFrame, code: str = "code") -> DataFrame:
    """rows with code_norm and code_key. A generated row holds both, so that no filter or aggregate works them out again."""
    both = F.transform(F.array(normalize_code(code)), lambda c: F.struct(c.alias("code_norm"), code_key(c).alias("code_key")))
    return rows.select("*", F.inline(both))


def _keyed_map(code_map: DataFrame) -> DataFrame:
    return code_map if "code_key" in code_map.columns else keyed(code_map.drop("code_norm"))


def page_boundaries(code_map: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(page, code_norm, code_key, code): the first keyable code of each page, by code text."""
    fit = _keyed_map(code_map).where("code_key is not null")
    first = fit.groupBy(*by, "page").agg(F.min(F.struct("code_norm", "code_key", "code")).alias("b"))
    return first.select(*by, "page", "b.code_norm", "b.code_key", "b.code")


def wanted_codes(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (code_norm, code_key) of rows that have a code."""
    return keyed(rows).where("code_norm <> ''").select(*by, "code_norm", "code_key").distinct()


def exact_pages(codes: DataFrame, code_map: DataFrame, top: int = TOP, by: tuple[str, ...] = ()) -> DataFrame:
    """(code_norm, rank, page, code, row_type): the first `top` map rows of each code by (page, code, row type)."""
    return _exact(wanted_codes(codes, by), _keyed_map(code_map), top, by)


def _exact(wanted: DataFrame, keyed_map: DataFrame, top: int, by: tuple[str, ...]) -> DataFrame:
    hits = keyed_map.join(wanted.select(*by, "code_norm"), [*by, "code_norm"], "left_semi")
    order = Window.partitionBy(*by, "code_norm").orderBy("page", "code_norm", "row_type", "code")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*by, "code_norm", "rank", "page", "code", "row_type")


def _asof(wanted: DataFrame, keyed_map: DataFrame, by: tuple[str, ...]) -> DataFrame:
    rest = wanted.join(keyed_map.select(*by, "code_norm"), [*by, "code_norm"], "left_anti").where("code_key is not null")
    # of boundaries with one key the smaller page counts
    at = page_boundaries(keyed_map, by).select(*by, "code_key", F.struct("page", "code").alias("at"))
    found = rest.join(last_before(rest, at, "code_key", "at", by), [*by, "code_key"])
    return found.select(*by, "code_norm", "at.page", "at.code", F.lit(BOUNDARY).alias("row_type"))


def asof_pages(codes: DataFrame, code_map: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(code_norm, page, code, row_type) of codes without an exact hit: the greatest boundary at or before the code's key."""
    return _asof(wanted_codes(codes, by), _keyed_map(code_map), by)


def page_hits(codes: DataFrame, code_map: DataFrame, by: tuple[str, ...] = (), top: int = TOP) -> DataFrame:
    """(code_norm, rank, page, code, row_type): what a look-up of each code shows, its exact rows or else one boundary.

    Codes and map are keyed once and written, since each is used in several joins.
    """
    wanted, keyed_map = written(wanted_codes(codes, by), "codes"), written(_keyed_map(code_map), "code-map")
    near = _asof(wanted, keyed_map, by).select(*by, "code_norm", F.lit(1).alias("rank"), "page", "code", "row_type")
    return _exact(wanted, keyed_map, top, by).unionByName(near)


def book_pages(rows: DataFrame, code_map: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each coded row with its book page, how it was found (exact, asof, none), the number of hits, and the code and row type of the first.

    With several books, rows and map have the columns `by`, and each row is looked up in its own book.
    """
    told = page_hits(rows, code_map, by).groupBy(*by, "code_norm").agg(F.min(F.struct("rank", "page", "code", "row_type")).alias("first"), F.count("*").alias("hits"))
    told = told.select(*by, "code_norm", "hits", F.col("first.page").alias("book_page"), F.col("first.code").alias("book_code"), F.col("first.row_type").alias("row_type"))
    out = keyed(rows).where("code_norm <> ''").join(told, [*by, "code_norm"], "left")
    found = F.when(F.col("book_page").isNull(), "none").when(F.col("row_type") == BOUNDARY, "asof").otherwise("exact")
    return out.withColumn("found", found).withColumn("hits", F.coalesce("hits", F.lit(0)))

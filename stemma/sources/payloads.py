"""Answers to look-ups of pages, references and nodes as JSON texts, many at a time.

Answers of any length come as blocks of at most `block_rows` rows; trees are rows in document order with the id of
their parent. An answer without rows is one block without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import followed, normalize_code, strip
from stemma.operators import codes, outline, references, search
from stemma.sources.batches import PAYLOAD_ROWS, _json, counted_rows, payload_blocks
from stemma.sources.scratch import spread, written


def page_payload(queries: DataFrame, code_map: DataFrame, by: tuple[str, ...] = (), top: int = codes.TOP) -> DataFrame:
    """(query_id, payload): {query, count, rows: [{page, code, row_type}], page} for each of queries(query_id, query).

    Rows are the first `top` exact ones, or the boundary at or before the code, with its own code and the row type
    `page_boundary`; page is that of the first row. A code that is asked for many times is looked up once.
    """
    asked = queries.select("query_id", *by, F.coalesce(strip("query"), F.lit("")).alias("query")).withColumn("code_norm", normalize_code("query"))
    hits = codes.page_hits(queries.withColumn("code", F.col("query")), code_map, by, top)
    found = hits.groupBy(*by, "code_norm").agg(F.sort_array(F.collect_list(F.struct("rank", "page", "code", "row_type"))).alias("found"))
    shown = F.transform("found", lambda r: F.struct(r["page"].alias("page"), r["code"].alias("code"), r["row_type"].alias("row_type")))
    out = asked.join(found, [*by, "code_norm"], "left").withColumn("rows", F.coalesce(shown, F.array().cast("array<struct<page:int,code:string,row_type:string>>")))
    return out.select("query_id", *by, _json("query", F.size("rows").alias("count"), "rows", F.get("rows", F.lit(0))["page"].alias("page")).alias("payload"))


def locate_payload(requests: DataFrame, rows: DataFrame, part: str, mark: bool = True, block_rows: int = PAYLOAD_ROWS) -> DataFrame:
    """(query_id, kind, block, payload): the rows that each of requests(query_id, query) points to, and their tree.

    Each distinct target, whatever its case, is resolved once. Targets that are not followed have the field `ignored`.
    Without `mark` no row counts as matched. The rows are written once for all that reads them.
    """
    rows = spread(rows, "pos", "rows")
    asked = written(requests.select("query_id", F.coalesce(strip("query"), F.lit("")).alias("query")).withColumn("target", F.lower("query")), "requests")
    found = references.resolve(rows, asked.select("target").where("target <> ''").distinct(), part)
    hits = written(found.where("pos is not null").select(F.col("target").alias("query_id"), "pos", F.lit(None).cast("int").alias("rank")), "hits")
    tree = search.nested(rows, search.with_paths(rows, hits, part, mark))
    blocks = payload_blocks(asked, "target", rows, hits, tree, part, block_rows, mark)
    ignored = F.when((F.col("target") == "") | followed(F.col("target")), "}").otherwise(',"ignored":true}')
    return blocks.select("query_id", "kind", "block", F.concat(counted_rows("query"), ignored).alias("payload"))


def children_payload(requests: DataFrame, rows: DataFrame, part: str, query: str = "", mode: str = "auto", fields=search.FIELDS, block_rows: int = PAYLOAD_ROWS, nodes: DataFrame | None = None) -> DataFrame:
    """(query_id, block, payload): {children: [...]} with all rows below each of requests(query_id, id), flagged by the query.

    The node itself is left out: rows right below it have no parent. An unknown id has no children; where only some rows
    may be asked for, `nodes` holds them, and the ids of all others are unknown. Several requests for one node share its rows.
    """
    known = search.node_positions(rows if nodes is None else nodes, requests)
    asked = written(requests.select("query_id", "id").join(known, "id", "left"), "requests")
    below = outline.subtree_rows(rows, asked.where("pos is not null").select(F.col("pos").alias("node")), part)
    tree = written(below.select(F.col("node").alias("query_id"), "pos", search.match_flag(query, mode, fields).alias("matched")), "below")
    none = tree.limit(0).select("query_id", "pos", F.lit(None).cast("int").alias("rank"))
    blocks = payload_blocks(asked, "pos", rows, none, search.nested(rows, tree), part, block_rows, kinds=("tree",))
    return blocks.select("query_id", "block", F.concat(F.lit('{"children":'), "rows", F.lit("}")).alias("payload"))

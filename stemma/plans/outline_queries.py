"""Trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import outline, search
from stemma.plans.views import view, with_views

ROWS = """r AS (SELECT *, greatest(level, 0) AS depth FROM outline), n AS (SELECT *, lead(level) OVER (ORDER BY pos) AS next_level FROM r),
kids AS (SELECT *, coalesce(next_level > level, false) AS has_children FROM n),
parents AS (SELECT a.pos, max(b.pos) AS parent_pos FROM r a JOIN r b ON b.pos < a.pos AND b.depth < a.depth GROUP BY a.pos),
ends AS (SELECT a.pos, min(b.pos) AS end_pos FROM r a JOIN r b ON b.pos > a.pos AND b.depth <= a.depth GROUP BY a.pos)"""


def has_children(spark, d):
    return outline.has_children(view(spark, d, "outline"), "file_rank").select("pos", "has_children")


def ancestors(spark, d):
    rows = outline.with_ancestors(view(spark, d, "outline"), "file_rank")
    return rows.select("pos", F.posexplode("ancestors").alias("depth", "ancestor"))


def subtree_sizes(spark, d):
    rows = outline.with_subtree_end(view(spark, d, "outline"), "file_rank")
    return rows.select("pos", (F.col("end_ord") - F.col("ord") - 1).alias("size"))


def subtree_rows(spark, d):
    rows = view(spark, d, "outline").withColumn("code", F.lit(""))
    nodes = rows.where("level <= 1 or pos % 50 = 3").select(F.col("pos").alias("node"))
    found = outline.subtree_rows(rows, nodes, "file_rank")
    return found.select("node", "pos", "level", "has_children", search.match_flag("CLICK", fields=("english", "level")).alias("matched"))


def subset_edges(spark, d):
    """Parents inside a subset of the rows, level-0 rows included."""
    rows = view(spark, d, "outline").where("(pos * 7) % 5 <> 1")
    return outline.with_parent(rows, "file_rank").select("pos", "parent_pos")


QUERIES = {f.__name__: f for f in (has_children, ancestors, subtree_sizes, subtree_rows, subset_edges)}

ORACLE_SQL = {
    "has_children": with_views(f"{ROWS} SELECT pos, has_children FROM kids", "outline"),
    "ancestors": with_views(
        f"""{ROWS}, chain AS (SELECT p.pos, p.parent_pos AS ancestor, a.depth AS l FROM parents p JOIN r a ON a.pos = p.parent_pos WHERE a.depth > 0
  UNION ALL SELECT c.pos, p.parent_pos, a.depth FROM chain c JOIN parents p ON p.pos = c.ancestor JOIN r a ON a.pos = p.parent_pos WHERE a.depth > 0)
SELECT pos, CAST(row_number() OVER (PARTITION BY pos ORDER BY l) - 1 AS INT) AS depth, ancestor FROM chain""",
        "outline",
        recursive=True,
    ),
    "subtree_sizes": with_views(
        f"""{ROWS}, o AS (SELECT pos, row_number() OVER (ORDER BY pos) AS ord, count(*) OVER () AS n FROM r)
SELECT o.pos, coalesce(e.ord, o.n + 1) - o.ord - 1 AS size FROM o LEFT JOIN ends x ON x.pos = o.pos LEFT JOIN o e ON e.pos = x.end_pos""",
        "outline",
    ),
    "subtree_rows": with_views(
        f"""{ROWS}, nodes AS (SELECT r.pos AS node, coalesce(e.end_pos, 9223372036854775807) AS stop FROM r LEFT JOIN ends e USING (pos) WHERE level <= 1 OR pos % 50 = 3)
SELECT node, k.pos, k.level, k.has_children, contains(lower(concat(k.english, ' ', k.level)), 'click') AS matched FROM nodes JOIN kids k ON k.pos > node AND k.pos < stop""",
        "outline",
    ),
    "subset_edges": with_views(
        """s AS (SELECT pos, greatest(level, 0) AS depth FROM outline WHERE (pos * 7) % 5 <> 1)
SELECT a.pos, max(b.pos) AS parent_pos FROM s a LEFT JOIN s b ON b.pos < a.pos AND b.depth < a.depth GROUP BY a.pos""",
        "outline",
    ),
}

"""Search."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions.text import row_id
from stemma.operators import outline, search
from stemma.plans.views import view, with_views
from stemma.sources.batches import payload
from stemma.sources.scratch import written

BLOB = "trim(concat(lower(chinese), ' ', lower(english), ' ', lower(code)))"
HITS = rf"""q AS (SELECT query_id, lower(trim(query)) AS q, mode, regexp_full_match(lower(trim(query)), '\d+(\.\d+)?') OR mode = 'code' AS is_code FROM queries),
code_hits AS (SELECT query_id, idx.*, lower(code) = q AS is_exact FROM idx JOIN q ON is_code AND starts_with(lower(code), q)),
codes AS (SELECT * FROM code_hits h WHERE is_exact = (SELECT max(is_exact) FROM code_hits x WHERE x.query_id = h.query_id)),
texts AS (SELECT query_id, idx.* FROM idx JOIN q ON NOT is_code AND CASE WHEN mode = 'any'
  THEN len(list_filter(string_split(q, ' '), lambda t: t <> '' AND contains({BLOB}, t))) > 0 ELSE contains({BLOB}, q) END),
hits AS (SELECT query_id, pos FROM codes UNION ALL SELECT query_id, pos FROM texts)"""
WAY = """depths AS (SELECT pos, greatest(level, 0) AS depth FROM idx),
parents AS (SELECT a.pos, max(b.pos) AS parent FROM depths a JOIN depths b ON b.pos < a.pos AND b.depth < a.depth GROUP BY a.pos),
up AS (SELECT p.pos, p.parent AS above FROM parents p JOIN depths d ON d.pos = p.parent WHERE d.depth > 0
  UNION ALL SELECT u.pos, p.parent FROM up u JOIN parents p ON p.pos = u.above JOIN depths d ON d.pos = p.parent WHERE d.depth > 0),
tree AS (SELECT query_id, t.pos, bool_or(matched) AS matched FROM (SELECT query_id, pos, true AS matched FROM hits
  UNION ALL SELECT query_id, above, false FROM hits JOIN up USING (pos)) t JOIN idx i ON i.pos = t.pos WHERE i.level <> 0 GROUP BY query_id, t.pos)"""

EDGES = """edges AS (SELECT a.query_id, a.pos, any_value(a.matched) AS matched, max(b.pos) AS parent_pos FROM (SELECT * FROM tree JOIN depths USING (pos)) a
  LEFT JOIN (SELECT * FROM tree JOIN depths USING (pos)) b ON b.query_id = a.query_id AND b.pos < a.pos AND b.depth < a.depth GROUP BY a.query_id, a.pos)"""
KIDS = "kids AS (SELECT pos, coalesce(lead(level) OVER (ORDER BY pos) > level, false) AS has_children FROM idx)"
ID = "concat(page, '-', level, '-', source_file, '-', source_line)"
ASKED = f"asked AS (SELECT {ID} AS id, pos FROM idx WHERE level <= 1 OR pos % 40 = 3)"
ZH, EN = r"(?:[-（(]?\s*)(另见|见)\s*([^；;\n]+)", r"(?i)\b(see also|see)\s+([^;\n]+)"


def _idx(spark, d):
    # files are numbered by their first page, so that parts follow pos
    part = F.regexp_extract("source_file", r"-(\d+)-\d+\.csv$", 1).cast("int")
    return view(spark, d, "idx").withColumn("part", part), view(spark, d, "queries")


def browse_root(spark, d):
    return search.browse(_idx(spark, d)[0]).select("pos", "page", "english")


def search_code(spark, d):
    rows, queries = _idx(spark, d)
    return search.search_codes(rows, queries, "part")


def _mode(spark, d, mode):
    rows, queries = _idx(spark, d)
    return search.search_texts(rows, queries.where(F.col("mode") == mode))


def search_phrase(spark, d):
    return _mode(spark, d, "phrase")


def search_any(spark, d):
    return _mode(spark, d, "any")


def search_fields(spark, d):
    rows, queries = _idx(spark, d)
    return search.search_texts(rows, queries, ("code", "english"))


def search_ranges(spark, d):
    """The middle half of all pages is cut out first; children are those on what is left."""
    rows, queries = _idx(spark, d)
    last = rows.agg(F.max("page")).first()[0] or 0
    rows = search.restrict(rows, page_min=last // 4, page_max=3 * last // 4, level_min=2, level_max=5)
    return search.results(rows, search.search_texts(rows, queries), "part").select("query_id", "pos", "has_children")


def search_files(spark, d):
    """Every second file, by a frame of names; the rest is out before children are told."""
    rows, queries = _idx(spark, d)
    rows = search.restrict(rows, files=rows.where("part % 10 = 1").select("source_file"))
    return search.results(rows, search.search_texts(rows, queries), "part").select("query_id", "pos", "has_children")


def search_many(spark, d):
    """All queries, an empty one too."""
    rows, queries = _idx(spark, d)
    blank = spark.createDataFrame([(10, " ", "auto")], queries.schema)
    return search.search(rows, queries.unionByName(blank), part="part").select("query_id", "pos")


#: Each row's code and words as queries of their own, whole texts and pairs of pieces of words too; the text runs on both sides.
NEEDLES = """SELECT DISTINCT q FROM (SELECT lower(english) AS q FROM idx UNION ALL SELECT lower(split_part(english, ' ', 1)) FROM idx UNION ALL SELECT lower(substr(english, 2, 9)) FROM idx
  UNION ALL SELECT lower(substr(chinese, length(chinese) - 1, 3)) FROM idx UNION ALL SELECT concat(lower(substr(english, 1, 4)), 'q') FROM idx UNION ALL SELECT lower(substr(english, 1, 2)) FROM idx) n WHERE trim(q) = q AND q <> ''"""


def search_index(spark, d):
    """Thousands of phrases taken from the rows, by the index of pieces: hits of each."""
    rows = _idx(spark, d)[0]
    asked = spark.sql(NEEDLES.replace("FROM idx", "FROM {idx}"), idx=rows).select(F.col("q").alias("query_id"), F.col("q").alias("query"), F.lit("phrase").alias("mode"))
    hits = search.search_texts(rows, asked, index=search.text_index(rows))
    return hits.groupBy("query_id").agg(F.count("*").alias("n_rows"), F.min("pos").alias("first_pos"))


def search_tree(spark, d):
    rows, queries = _idx(spark, d)
    return search.nested(rows, search.with_paths(rows, search.search(rows, queries, part="part"), "part"))


def search_tree_unmarked(spark, d):
    """The tree of the hits without their marks."""
    rows, queries = _idx(spark, d)
    return search.nested(rows, search.with_paths(rows, search.search(rows, queries, part="part"), "part", mark=False))


def search_counts(spark, d):
    rows, queries = _idx(spark, d)
    return search.counts(queries, search.search(rows, queries, part="part"))


PAYLOAD_ROWS = 40


def payload_json(spark, d):
    """Rows and tree of each query in texts of 40 rows."""
    rows, queries = _idx(spark, d)
    hits = written(search.search(rows, queries, part="part"), "hits")
    tree = written(search.nested(rows, search.with_paths(rows, hits, "part")), "tree")
    return payload(queries, rows, hits, tree, "part", PAYLOAD_ROWS)


def _asked_nodes(rows):
    """Ids of some rows, and of none."""
    known = rows.where("level <= 1 or pos % 40 = 3").select(row_id().alias("id"))
    return known.unionByName(known.select(F.concat("id", F.lit("0")).alias("id")))


def node_positions(spark, d):
    rows = _idx(spark, d)[0]
    return search.node_positions(rows, _asked_nodes(rows))


def node_children(spark, d):
    """All rows below nodes named by id, with flags of a code, an any-token and a phrase query."""
    rows = _idx(spark, d)[0]
    nodes = search.node_positions(rows, _asked_nodes(rows))
    below = outline.subtree_rows(rows, nodes.select(F.col("pos").alias("node")), "part").join(nodes.withColumnRenamed("pos", "node").withColumnRenamed("id", "node_id"), "node")
    flags = {"code": search.match_flag("04"), "any": search.match_flag("small  12.3", "any"), "phrase": search.match_flag("SMALL BR", "phrase"), "none": search.match_flag(" ")}
    return below.select("node_id", row_id().alias("id"), "has_children", *[f.alias(f"is_{k}") for k, f in flags.items()])


QUERIES = {f.__name__: f for f in (browse_root, search_code, search_phrase, search_any, search_fields, search_ranges, search_files, search_many, search_index, search_tree, search_tree_unmarked, search_counts, payload_json, node_positions, node_children)}


def _sql(select: str, more: str = "", recursive: bool = False) -> str:
    return with_views(f"{HITS}{more} {select}", "idx", "queries", recursive=recursive)


ORACLE_SQL = {
    "browse_root": with_views("SELECT pos, page, english FROM idx WHERE level = 0", "idx"),
    "search_code": _sql(
        """SELECT query_id, pos, is_exact, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN is_exact THEN page END, CASE WHEN is_exact THEN level END,
  CASE WHEN is_exact THEN source_file END, CASE WHEN is_exact THEN source_line END, pos) AS INT) AS rank FROM codes"""
    ),
    "search_phrase": _sql("SELECT query_id, pos FROM texts JOIN queries USING (query_id) WHERE mode = 'phrase'"),
    "search_any": _sql("SELECT query_id, pos FROM texts JOIN queries USING (query_id) WHERE mode = 'any'"),
    "search_fields": with_views(
        f"""{HITS.replace(BLOB, "trim(concat(lower(code), ' ', lower(english)))")} SELECT query_id, pos FROM texts""", "idx", "queries"
    ),
    "search_ranges": with_views(
        f"""inside AS (SELECT * FROM idx WHERE page BETWEEN (SELECT max(page) // 4 FROM idx) AND (SELECT 3 * max(page) // 4 FROM idx) AND level BETWEEN 2 AND 5),
kids AS (SELECT pos, coalesce(lead(level) OVER (ORDER BY pos) > level, false) AS has_children FROM inside),
{HITS.replace("FROM idx", "FROM inside").replace("idx.*", "inside.*")} SELECT query_id, pos, has_children FROM texts JOIN kids USING (pos)""",
        "idx",
        "queries",
    ),
    "search_files": with_views(
        f"""inside AS (SELECT * FROM idx WHERE CAST(split_part(source_file, '-', 3) AS INT) % 10 = 1),
kids AS (SELECT pos, coalesce(lead(level) OVER (ORDER BY pos) > level, false) AS has_children FROM inside),
{HITS.replace("FROM idx", "FROM inside").replace("idx.*", "inside.*")} SELECT query_id, pos, has_children FROM texts JOIN kids USING (pos)""",
        "idx",
        "queries",
    ),
    "search_index": with_views(
        f"""needles AS ({NEEDLES}), blobs AS (SELECT pos, {BLOB} AS blob FROM idx)
SELECT q AS query_id, count(*) AS n_rows, min(pos) AS first_pos FROM needles JOIN blobs ON contains(blob, q) WHERE NOT regexp_full_match(q, '\\d+(\\.\\d+)?') GROUP BY q""",
        "idx",
    ),
    "search_many": _sql("SELECT query_id, pos FROM hits UNION ALL SELECT 10, pos FROM idx WHERE level = 0"),
    "search_tree": _sql("SELECT * FROM edges", f", {WAY}, {EDGES}", recursive=True),
    "search_tree_unmarked": _sql("SELECT * REPLACE (false AS matched) FROM edges", f", {WAY}, {EDGES}", recursive=True),
    "node_positions": with_views(f"{ASKED} SELECT id, pos FROM asked", "idx"),
    "node_children": with_views(
        f"""{ASKED}, {KIDS}, ends AS (SELECT a.id AS node_id, a.pos, coalesce(min(b.pos), 9223372036854775807) AS stop FROM (SELECT a.id, a.pos, i.level FROM asked a JOIN idx i USING (pos)) a
  LEFT JOIN idx b ON b.pos > a.pos AND b.level <= a.level GROUP BY a.id, a.pos), told AS (SELECT *, lower(concat(chinese, ' ', english, ' ', code)) AS blob FROM idx)
SELECT node_id, {ID} AS id, has_children, starts_with(lower(code), '04') AS is_code, contains(blob, 'small') OR contains(blob, '12.3') AS is_any, contains(blob, 'small br') AS is_phrase, false AS is_none
FROM ends e JOIN told t ON t.pos > e.pos AND t.pos < e.stop JOIN kids k ON k.pos = t.pos""",
        "idx",
    ),
    "search_counts": _sql("SELECT query_id, count(pos) AS n_rows FROM queries LEFT JOIN hits USING (query_id) GROUP BY query_id"),
    "payload_json": _sql(
        f"""SELECT q.query_id, k.kind, CAST(coalesce(b.block, 0) AS INT) AS block, CAST(to_json({{'query': any_value(q.query), 'count': coalesce(any_value(b.n), 0),
  'rows': coalesce(list({{'id': b.id, 'page': b.page, 'level': b.level, 'code': b.code, 'chinese': b.chinese, 'english': b.english, 'source_file': b.source_file, 'source_line': b.source_line,
    'references': b.refs, 'has_children': b.has_children, 'matched': b.matched, 'parent_id': b.parent_id}} ORDER BY b.i) FILTER (b.id IS NOT NULL), [])}}) AS VARCHAR) AS payload
FROM queries q CROSS JOIN (VALUES ('rows'), ('tree')) k(kind) LEFT JOIN blocks b ON b.query_id = q.query_id AND b.kind = k.kind GROUP BY q.query_id, k.kind, b.block""",
        f""", {WAY}, {EDGES}, {KIDS}, refs AS (SELECT pos, regexp_extract_all(chinese, '{ZH}', 1) AS a, regexp_extract_all(chinese, '{ZH}', 2) AS b,
  regexp_extract_all(english, '{EN}', 1) AS c, regexp_extract_all(english, '{EN}', 2) AS d FROM idx),
listed AS (SELECT pos, list_filter(list_concat(list_transform(range(1, len(a) + 1), lambda i: {{'kind': a[i], 'target': trim(b[i])}}),
  list_transform(range(1, len(c) + 1), lambda i: {{'kind': lower(c[i]), 'target': trim(d[i])}})), lambda r: r.target <> '') AS refs FROM refs),
every AS (SELECT query_id, 'rows' AS kind, pos, true AS matched, CAST(NULL AS BIGINT) AS parent_pos, CASE WHEN c.is_exact THEN c.rank END AS rank FROM hits LEFT JOIN (
    SELECT query_id, pos, is_exact, row_number() OVER (PARTITION BY query_id ORDER BY page, level, source_file, source_line) AS rank FROM codes) c USING (query_id, pos)
  UNION ALL SELECT query_id, 'tree', pos, matched, parent_pos, NULL FROM edges),
blocks AS (SELECT e.query_id, e.kind, e.i, (e.i - 1) // {PAYLOAD_ROWS} AS block, e.n, e.matched, {ID} AS id, (SELECT {ID} FROM idx p WHERE p.pos = e.parent_pos) AS parent_id, t.*, has_children, l.refs
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank, pos) AS i, count(*) OVER (PARTITION BY query_id, kind) AS n FROM every) e JOIN idx t ON t.pos = e.pos JOIN kids k ON k.pos = e.pos JOIN listed l ON l.pos = e.pos)""",
        recursive=True,
    ),
}

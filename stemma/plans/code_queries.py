"""Codes, cells and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import codes
from stemma.operators.asof import last_before
from stemma.plans.views import view, with_views
from stemma.sources import batches, payloads
from stemma.sources.scratch import scratch

KEY = r"""CASE WHEN regexp_full_match(code_norm, '\d{1,2}(\.\d{1,2})?') THEN CAST(split_part(code_norm, '.', 1) AS INT) * 1000
 + CASE WHEN contains(code_norm, '.') THEN CAST(rpad(split_part(code_norm, '.', 2), 2, '0') AS INT) + 1 ELSE 0 END END"""
KEYED = rf"""keyed AS (SELECT *, {KEY} AS code_key FROM (SELECT *, CAST(floor(pos / 56.0) AS BIGINT) AS book, lower(regexp_replace(code, '\s+', '', 'g')) AS code_norm FROM idx)),
map AS (SELECT *, {KEY} AS code_key FROM (SELECT *, lower(regexp_replace(code, '\s+', '', 'g')) AS code_norm FROM (SELECT * REPLACE (coalesce(row_type, '') AS row_type) FROM code_map)) WHERE page BETWEEN 21 AND 415 AND code_norm <> ''),
bounds AS (SELECT book, page, code_norm, code_key, code FROM map WHERE code_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY code_norm, code) = 1),
exact AS (SELECT book, code_norm, row_number() OVER (PARTITION BY book, code_norm ORDER BY page, code_norm, row_type, code) AS rank, page, code, row_type
  FROM map m WHERE EXISTS (SELECT 1 FROM keyed k WHERE k.book = m.book AND k.code_norm = m.code_norm)),
hits AS (SELECT book, code_norm, min(page) AS page, count(*) AS hits FROM exact WHERE rank <= 10 GROUP BY book, code_norm)"""
NEAR = """best AS (SELECT k.book, k.pos, max(b.code_key) AS code_key FROM keyed k JOIN bounds b ON b.book = k.book AND b.code_key <= k.code_key
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.book = k.book AND h.code_norm = k.code_norm) GROUP BY k.book, k.pos),
near AS (SELECT t.pos, min(b.page) AS page, arg_min(b.code, b.page) AS code FROM best t JOIN bounds b USING (book, code_key) GROUP BY t.pos)"""


BOOK = ("book",)


def book_map(spark, d):
    """One map of codes for each of many books."""
    return batches.code_pages(view(spark, d, "code_map"), by=BOOK)


def book_rows(spark, d):
    """Index rows, dealt to the books in order."""
    return view(spark, d, "idx").withColumn("book", F.floor(F.col("pos") / 56.0).cast("bigint"))


def code_keys(spark, d):
    return codes.keyed(view(spark, d, "idx")).select("pos", "code_norm", "code_key")


def page_boundaries(spark, d):
    return codes.page_boundaries(book_map(spark, d), BOOK)


def code_page_exact(spark, d):
    return codes.exact_pages(book_rows(spark, d), book_map(spark, d), by=BOOK)


def code_page_asof(spark, d):
    return codes.book_pages(book_rows(spark, d), book_map(spark, d), BOOK).select("pos", "code_norm", "found", "book_page", "hits")


def code_page_hits(spark, d):
    """What a look-up of each code shows: its exact rows, or the boundary before it with its own code and row type."""
    return codes.page_hits(book_rows(spark, d), book_map(spark, d), BOOK)


def asof_text_keys(spark, d):
    """The last English text of the row's level at or before each Chinese one and each code, in the order of letters."""
    rows = view(spark, d, "idx").select("level", F.explode(F.array("chinese", "code", "english")).alias("key"))
    marks = view(spark, d, "idx").where("page % 3 = 1").select("level", F.col("english").alias("key"), F.col("pos").alias("mark"))
    return last_before(rows, marks, "key", "mark", ("level",))


#: Codes as they are typed: padded, with blanks inside, or missing; the text runs on both sides.
TYPED = "CASE CAST(pos % 6 AS INT) WHEN 0 THEN concat('　', code, ' ') WHEN 1 THEN concat(substr(code, 1, 1), ' ', substr(code, 2)) WHEN 2 THEN NULL ELSE code END"


def code_page_payload(spark, d):
    """The answer to a look-up of each row's code, as it is typed, in its book."""
    asked = book_rows(spark, d).select(F.col("pos").alias("query_id"), *BOOK, F.expr(TYPED).alias("query"))
    return payloads.page_payload(asked, book_map(spark, d), BOOK)


#: Cells as they come from files: padded, not numbers, or missing. Each text runs on both sides.
DIRTY = """CASE CAST(pos % 14 AS INT) WHEN 0 THEN '3.9' WHEN 1 THEN '-3.9' WHEN 2 THEN '' WHEN 3 THEN 'nan' WHEN 4 THEN '1e2' WHEN 5 THEN '1d'
 WHEN 6 THEN concat('　', CAST(page AS VARCHAR(9)), ' ') WHEN 7 THEN NULL WHEN 8 THEN '+5.' WHEN 9 THEN 'abc' WHEN 10 THEN 'inf' WHEN 11 THEN '-1' WHEN 12 THEN '.5' ELSE '1e400' END"""
PADDED = "CASE CAST(pos % 5 AS INT) WHEN 0 THEN concat('　', chinese, '  ') WHEN 1 THEN 'NaN' WHEN 2 THEN ' nan' WHEN 3 THEN NULL ELSE chinese END"


def parse_values(spark, d):
    raw = spark.sql(f"SELECT pos, {DIRTY} AS cell, {PADDED} AS text FROM {{idx}}", idx=view(spark, d, "idx"))
    return raw.select("pos", T.parse_int("cell", 7).alias("n"), T.parse_text("text").alias("t"), T.strip_indent("text").alias("u"))


PARSE_SQL = rf"""raw AS (SELECT pos, {DIRTY} AS cell, {PADDED} AS text FROM idx),
cut AS (SELECT pos, regexp_replace(cell, '^[\s　]+|[\s　]+$', '', 'g') AS cell, CASE WHEN lower(coalesce(text, '')) = 'nan' THEN ''
  ELSE regexp_replace(coalesce(text, ''), '^[\s　]+|[\s　]+$', '', 'g') END AS t FROM raw)
SELECT pos, CASE WHEN regexp_full_match(cell, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') AND abs(try_cast(cell AS DOUBLE)) < 9.2e18
  THEN CAST(trunc(try_cast(cell AS DOUBLE)) AS BIGINT) ELSE 7 END AS n, t, t AS u FROM cut"""


def row_ids(spark, d):
    return view(spark, d, "idx").select("pos", T.row_id().alias("row_id"))


def tree_preview(spark, d):
    return view(spark, d, "idx").select("pos", "level", T.tree_preview().alias("hierarchy"), "english", "code")


def csv_lines(spark, d):
    quoted = F.when(F.col("pos") % 7 == 0, F.concat(F.col("english"), F.lit(' "x", y'))).otherwise(F.col("english"))
    comma = F.when(F.col("pos") % 11 == 0, F.concat(F.col("code"), F.lit(',"'))).otherwise(F.col("code"))
    return view(spark, d, "idx").withColumn("english", quoted).withColumn("code", comma).select("pos", T.csv_line().alias("line"))


CSV_SQL = """c AS (SELECT pos, page, level, chinese, CASE WHEN pos % 7 = 0 THEN concat(english, ' "x", y') ELSE english END AS english,
  CASE WHEN pos % 11 = 0 THEN concat(code, ',"') ELSE code END AS code FROM idx)
SELECT pos, concat(page, ',', level, ',"', replace(chinese, '"', '""'), '","', replace(english, '"', '""'), '",',
  CASE WHEN contains(code, ',') OR contains(code, '"') THEN concat('"', replace(code, '"', '""'), '"') ELSE code END) AS line FROM c"""

NAMES = """SELECT source_file AS name FROM idx UNION ALL SELECT concat('notes-', source_file, '.bak') FROM idx
UNION ALL SELECT concat('index-extraction-', CAST(pos AS VARCHAR(9)), '-', CAST(pos + pos % 9 AS VARCHAR(9)), '.csv') FROM idx"""


def batch_discovery(spark, d):
    return batches.batches_of(spark.sql(NAMES.replace("FROM idx", "FROM {idx}"), idx=view(spark, d, "idx")))


DISCOVERY_SQL = rf"""names AS ({NAMES}), found AS (SELECT DISTINCT name, CAST(regexp_extract(name, 'index-extraction-(\d+)-(\d+)\.csv$', 1) AS INT) AS start_page,
  CAST(regexp_extract(name, 'index-extraction-(\d+)-(\d+)\.csv$', 2) AS INT) AS end_page FROM names WHERE regexp_matches(name, 'index-extraction-(\d+)-(\d+)\.csv$'))
SELECT * FROM found WHERE end_page - start_page <= 4"""


def load_code_map(spark, d):
    """The map written as a CSV file and loaded from it."""
    path = scratch(spark, "code-map")
    view(spark, d, "code_map").select("page", "code", "row_type").write.option("header", True).csv(path)
    return batches.load_code_pages(spark, path)


def state(spark, d):
    """Edit state of the idx rows."""
    return view(spark, d, "idx").select(
        F.concat(F.lit("u"), F.col("pos").cast("string")).alias("uid"), "page", "level", "chinese", "english", "code", "source_file", "source_line",
        F.col("source_line").cast("double").alias("ord"), F.lit(False).alias("deleted"), F.lit(False).alias("is_new"),
    )


#: Cells with line breaks, quotes and commas; the text runs on both sides.
BROKEN = """CASE WHEN source_line % 13 = 0 THEN concat(english, chr(10), '"two", lines', chr(10), chr(10), 'and more') WHEN source_line % 13 = 1 THEN concat('"', english) ELSE english END"""


def write_roundtrip(spark, d):
    """Files written from the state, two of three, some cells with line breaks, and loaded again."""
    out, files = scratch(spark, "batches"), view(spark, d, "files")
    batches.write_batches(state(spark, d).withColumn("english", F.expr(BROKEN)), files, files.where("start_page % 3 <> 0"), out)
    return batches.read_back(spark, out)


def save_in_place(spark, d):
    """All files written, then every third one again in its place, with its rows on later pages gone; the whole loaded."""
    out, files, rows = scratch(spark, "batches"), view(spark, d, "files"), state(spark, d)
    batches.write_batches(rows, files, files, out)
    gone = rows.withColumn("deleted", F.col("page") % 5 >= 3).withColumn("english", F.concat("english", F.lit(" again")))
    batches.write_batches(gone, files, files.where("start_page % 3 = 0"), out, in_place=True)
    return batches.read_back(spark, out)


IN_PLACE_SQL = """saved AS (SELECT i.* REPLACE (CASE WHEN f.start_page % 3 = 0 THEN concat(i.english, ' again') ELSE i.english END AS english), f.name FROM idx i JOIN files f ON i.page BETWEEN f.start_page AND f.end_page
  WHERE f.start_page % 3 <> 0 OR i.page % 5 < 3)
SELECT name AS source_file, CAST(1 + row_number() OVER (PARTITION BY name ORDER BY page, source_line) AS INT) AS source_line, page, level, chinese, english, code FROM saved"""

ROUNDTRIP_SQL = f"""written AS (SELECT i.* REPLACE ({BROKEN} AS english), f.name FROM idx i JOIN files f ON i.page BETWEEN f.start_page AND f.end_page WHERE f.start_page % 3 <> 0)
SELECT name AS source_file, CAST(1 + row_number() OVER (PARTITION BY name ORDER BY page, source_line) AS INT) AS source_line, page, level, chinese, english, code FROM written"""

QUERIES = {f.__name__: f for f in (code_keys, page_boundaries, code_page_exact, code_page_asof, code_page_hits, code_page_payload, asof_text_keys, parse_values, row_ids, tree_preview, csv_lines, batch_discovery, load_code_map, write_roundtrip, save_in_place)}

ORACLE_SQL = {
    "code_keys": with_views(f"{KEYED} SELECT pos, code_norm, code_key FROM keyed", "idx", "code_map"),
    "page_boundaries": with_views(f"{KEYED} SELECT book, page, code_norm, code_key, code FROM bounds", "idx", "code_map"),
    "code_page_exact": with_views(f"{KEYED} SELECT book, code_norm, CAST(rank AS INT) AS rank, page, code, row_type FROM exact WHERE rank <= 10", "idx", "code_map"),
    "code_page_asof": with_views(
        f"""{KEYED}, {NEAR}
SELECT k.pos, k.code_norm, CASE WHEN h.page IS NOT NULL THEN 'exact' WHEN a.page IS NOT NULL THEN 'asof' ELSE 'none' END AS found, coalesce(h.page, a.page) AS book_page,
  CAST(coalesce(h.hits, CASE WHEN a.page IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits
FROM keyed k LEFT JOIN hits h ON h.book = k.book AND h.code_norm = k.code_norm LEFT JOIN near a ON a.pos = k.pos WHERE k.code_norm <> ''""",
        "idx",
        "code_map",
    ),
    "asof_text_keys": with_views(
        """asked AS (SELECT DISTINCT level, key FROM (SELECT level, chinese AS key FROM idx UNION ALL SELECT level, code FROM idx UNION ALL SELECT level, english FROM idx) a),
marks AS (SELECT level, english AS key, min(pos) AS mark FROM idx WHERE page % 3 = 1 GROUP BY level, english),
best AS (SELECT a.level, a.key, max(m.key) AS at FROM asked a JOIN marks m ON m.level = a.level AND m.key <= a.key GROUP BY a.level, a.key)
SELECT b.level, b.key, m.mark FROM best b JOIN marks m ON m.level = b.level AND m.key = b.at""",
        "idx",
    ),
    "code_page_hits": with_views(
        f"""{KEYED}, {NEAR} SELECT book, code_norm, CAST(rank AS INT) AS rank, page, code, row_type FROM exact WHERE rank <= 10
UNION ALL SELECT DISTINCT k.book, k.code_norm, 1, a.page, a.code, 'page_boundary' FROM near a JOIN keyed k USING (pos)""",
        "idx",
        "code_map",
    ),
    "code_page_payload": with_views(
        f"""asked AS (SELECT pos, CAST(floor(pos / 56.0) AS BIGINT) AS book, coalesce(regexp_replace({TYPED}, '^[\\s　]+|[\\s　]+$', '', 'g'), '') AS query FROM idx),
{KEYED}, {NEAR}, told AS (SELECT a.*, k.code_norm FROM asked a JOIN keyed k USING (pos)),
shown AS (SELECT pos, [{{'page': page, 'code': code, 'row_type': 'page_boundary'}}] AS rows FROM near
  UNION ALL SELECT t.pos, list({{'page': e.page, 'code': e.code, 'row_type': e.row_type}} ORDER BY e.rank) FROM told t JOIN exact e ON e.book = t.book AND e.code_norm = t.code_norm WHERE e.rank <= 10 GROUP BY t.pos)
SELECT t.pos AS query_id, t.book, CAST(to_json({{'query': t.query, 'count': coalesce(len(s.rows), 0), 'rows': coalesce(s.rows, []), 'page': s.rows[1].page}}) AS VARCHAR) AS payload
FROM told t LEFT JOIN shown s ON s.pos = t.pos AND t.query <> ''""",
        "idx",
        "code_map",
    ),
    "parse_values": with_views(PARSE_SQL, "idx"),
    "row_ids": with_views("SELECT pos, concat(page, '-', level, '-', source_file, '-', source_line) AS row_id FROM idx", "idx"),
    "tree_preview": with_views("SELECT pos, level, concat(repeat('　', greatest(level, 0)), chinese) AS hierarchy, english, code FROM idx", "idx"),
    "csv_lines": with_views(CSV_SQL, "idx"),
    "batch_discovery": with_views(DISCOVERY_SQL, "idx"),
    "load_code_map": with_views(r"SELECT page, code, coalesce(row_type, '') AS row_type, lower(regexp_replace(code, '\s+', '', 'g')) AS code_norm FROM code_map WHERE page BETWEEN 21 AND 415", "code_map"),
    "write_roundtrip": with_views(ROUNDTRIP_SQL, "idx", "files"),
    "save_in_place": with_views(IN_PLACE_SQL, "idx", "files"),
}

"""Index-shaped views over the driver's tables; each text runs in Spark SQL and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "idx": """
SELECT CAST(p_partkey AS BIGINT) AS pos,
 CAST(1 + floor(p_partkey / 40.0) AS INT) AS page,
 CAST(CASE WHEN p_partkey % 397 = 100 THEN 0 WHEN p_partkey % 13 = 4 THEN 1
      ELSE 2 + (p_partkey * 7 + p_size) % 5 END AS INT) AS level,
 concat(p_type, '术', CASE WHEN p_partkey % 17 = 5 THEN concat('-见', split_part(p_name, ' ', 1))
      WHEN p_partkey % 17 = 6 THEN concat('—另见', p_type, '术') ELSE '' END) AS chinese,
 concat(p_name, CASE p_partkey % 17 WHEN 1 THEN concat('-see ', p_name)
      WHEN 2 THEN concat('-see also ', split_part(p_name, ' ', 1))
      WHEN 3 THEN concat('-see ', split_part(p_name, ' ', 1), ', ', split_part(p_name, ' ', 2))
      WHEN 4 THEN concat('-See also ', split_part(p_name, ' ', 2), ', ', split_part(p_name, ' ', 1))
      WHEN 7 THEN '-see subcategory 12.3' WHEN 8 THEN '-see entry at 04.07'
      WHEN 9 THEN '-see 12.34; see also nothing here' ELSE '' END) AS english,
 CASE WHEN p_partkey % 100 = 12 THEN '12.34' WHEN p_partkey % 100 = 4 THEN '04.07'
      WHEN p_partkey % 8 = 0 THEN ''
      WHEN p_partkey % 50 = 1 THEN concat(lpad(CAST(p_partkey % 100 AS VARCHAR(9)), 2, '0'), '.87[45.51]')
      WHEN p_partkey % 10 = 3 THEN concat(lpad(CAST(p_partkey % 100 AS VARCHAR(9)), 2, '0'), '.', CAST(p_size % 10 AS VARCHAR(9)))
      ELSE concat(lpad(CAST(p_partkey % 100 AS VARCHAR(9)), 2, '0'), '.', lpad(CAST((p_partkey * 7 + p_size * 3) % 100 AS VARCHAR(9)), 2, '0')) END AS code,
 concat('index-extraction-', CAST(CAST(1 + 5 * floor(p_partkey / 200.0) AS INT) AS VARCHAR(9)), '-',
        CAST(CAST(5 + 5 * floor(p_partkey / 200.0) AS INT) AS VARCHAR(9)), '.csv') AS source_file,
 CAST(p_partkey % 200 + 2 AS INT) AS source_line
FROM part
""",
    "outline": """
SELECT event_id AS pos, CAST(floor(event_id / 200.0) AS BIGINT) AS file_rank,
 CAST(CASE WHEN event_id % 997 = 500 THEN 0 WHEN event_id % 23 = 9 THEN 1
      ELSE 2 + (event_id * 31 + user_id * 7) % 6 END AS INT) AS level, event_type AS english
FROM events
""",
    "code_map": """
SELECT CAST(floor(o_orderkey / 420.0) AS BIGINT) AS book, CAST(15 + o_orderkey % 420 AS INT) AS page,
 CASE WHEN o_orderkey % 19 = 7 THEN lpad(CAST(CAST(floor(o_orderkey % 420 / 4.0) AS INT) AS VARCHAR(9)), 2, '0')
      WHEN o_orderkey % 5 = 2 THEN concat(lpad(CAST(CAST(floor(o_orderkey % 420 / 4.0) AS INT) AS VARCHAR(9)), 2, '0'), '.', CAST(o_orderkey % 4 * 2 AS VARCHAR(9)))
      ELSE concat(lpad(CAST(CAST(floor(o_orderkey % 420 / 4.0) AS INT) AS VARCHAR(9)), 2, '0'), '.', lpad(CAST(o_orderkey % 4 * 21 AS VARCHAR(9)), 2, '0')) END AS code,
 CASE o_orderkey % 3 WHEN 0 THEN 'row' WHEN 1 THEN '' END AS row_type
FROM orders
UNION ALL SELECT CAST(floor(o_orderkey / 420.0) AS BIGINT), CAST(15 + o_orderkey % 420 AS INT),
 concat(lpad(CAST(CAST(floor(o_orderkey % 420 / 4.0) AS INT) AS VARCHAR(9)), 2, '0'), '.', lpad(CAST(o_orderkey % 4 * 21 AS VARCHAR(9)), 2, '0')), 'range'
FROM orders WHERE o_orderkey % 7 IN (1, 4)
""",
    "files": """
SELECT source_file AS name, CAST(split_part(source_file, '-', 3) AS INT) AS start_page,
 CAST(split_part(split_part(source_file, '-', 4), '.', 1) AS INT) AS end_page
FROM (SELECT DISTINCT source_file FROM idx) f
""",
    "edits": """
SELECT page AS edit_page, CAST(row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS INT) AS position,
 CASE WHEN pos % 11 = 5 THEN '' ELSE concat('u', CAST(pos AS VARCHAR(19))) END AS uid,
 CAST(CASE WHEN pos % 11 = 1 THEN page + 1 ELSE page END AS INT) AS page, level,
 CAST(CASE WHEN pos % 11 = 3 THEN 0 ELSE source_line END AS INT) AS ord,
 chinese, CASE WHEN pos % 11 = 2 THEN concat(english, ' NEC') ELSE english END AS english, code
FROM idx WHERE page % 7 = 3 AND pos % 11 <> 0
UNION ALL SELECT page + 7, CAST(1000 + pos % 40 AS INT), concat('u', CAST(pos AS VARCHAR(19))), CAST(page + 7 AS INT), level, 500, chinese, concat(english, ' again'), code
FROM idx WHERE page % 7 = 3 AND pos % 11 = 4
""",
    "queries": """
SELECT * FROM (VALUES (1, 'red', 'auto'), (2, 'see also', 'phrase'), (3, 'ring bolt', 'any'),
 (4, '12.34', 'auto'), (5, '04.', 'code'), (6, '99', 'auto'), (7, 'zzz', 'auto'), (8, 'SMALL', 'phrase'), (9, '12.3', 'auto')) AS q(query_id, query, mode)
""",
}
#: View -> the tables or views it reads.
NEEDS = {"idx": ["part"], "outline": ["events"], "code_map": ["orders"], "files": ["idx"], "edits": ["idx"], "queries": []}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, or a table of the driver."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, inputs = VIEWS[name], {}
    for source in NEEDS[name]:
        text = text.replace(f"FROM {source}", f"FROM {{{source}}}")
        inputs[source] = view(spark, sf_dir, source)
    return spark.sql(text, **inputs)


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """sql for DuckDB with the named views, and those they need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for source in NEEDS.get(name, ()):
            add(source)
        if name in VIEWS and name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    return f"WITH {'RECURSIVE ' * recursive}{ctes}{',' * (not sql.lstrip().upper().startswith('SELECT'))}\n{sql}"

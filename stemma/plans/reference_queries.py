"""Cross-references."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stemma.functions.text import reference_spans
from stemma.operators import references as R
from stemma.plans.views import view, with_views
from stemma.sources.scratch import spread, written

REFS = r"""found AS (
  SELECT pos, 'zh' AS lang, unnest(regexp_extract_all(chinese, '(?:[-（(]?\s*)(另见|见)\s*([^；;\n]+)', 1)) AS kind, unnest(regexp_extract_all(chinese, '(?:[-（(]?\s*)(另见|见)\s*([^；;\n]+)', 2)) AS target FROM idx
  UNION ALL
  SELECT pos, 'en', lower(unnest(regexp_extract_all(english, '(?i)\b(see also|see)\s+([^;\n]+)', 1))), unnest(regexp_extract_all(english, '(?i)\b(see also|see)\s+([^;\n]+)', 2)) FROM idx),
refs AS (SELECT pos, lang, kind, trim(target) AS target FROM found WHERE trim(target) <> ''),
terms AS (SELECT trim(lower(chinese)) AS term, 'zh' AS lang, pos FROM idx UNION ALL SELECT trim(lower(english)), 'en', pos FROM idx),
all_targets AS (SELECT DISTINCT lower(trim(target)) AS target FROM refs),
ignored AS (SELECT target FROM all_targets WHERE contains(target, '亚目') OR contains(target, 'subcategory')),
targets AS (SELECT target, regexp_full_match(target, '\d+(\.\d+)?') AS is_code FROM all_targets WHERE target NOT IN (SELECT target FROM ignored)),
exact AS (SELECT target, pos FROM targets JOIN idx ON is_code AND lower(code) = target
  UNION SELECT target, pos FROM targets JOIN terms ON NOT is_code AND term = target),
prefix AS (SELECT DISTINCT target, pos FROM targets JOIN terms ON NOT is_code AND starts_with(term, target)),
paths AS (SELECT target, list_filter(list_transform(regexp_split_to_array(target, '[，,]'), lambda p: trim(p)), lambda p: p <> '') AS parts
  FROM targets WHERE contains(target, ',') AND NOT is_code),
two AS (SELECT target, parts, parts[1] AS a, parts[2] AS b FROM paths WHERE len(parts) = 2),
heads AS (SELECT DISTINCT target, b, pos FROM two JOIN terms ON term = a OR (starts_with(term, a) AND contains(' ,-/()—', substr(term, length(a) + 1, 1)))),
row_ends AS (SELECT x.pos, coalesce(min(y.pos), 9223372036854775807) AS stop FROM idx x LEFT JOIN idx y ON y.pos > x.pos AND y.level <= x.level GROUP BY x.pos),
below AS (SELECT h.target, h.pos, min(t.pos) AS goal FROM heads h JOIN row_ends e ON e.pos = h.pos JOIN terms t ON t.pos > h.pos AND t.pos < e.stop AND contains(t.term, b) GROUP BY h.target, h.pos),
walked AS (SELECT h.target, h.pos AS head, coalesce(w.goal, (SELECT min(t.pos) FROM terms t WHERE t.pos = h.pos AND contains(t.term, h.b))) AS goal
  FROM heads h LEFT JOIN below w ON w.target = h.target AND w.pos = h.pos),
path AS (SELECT target, arg_min(goal, head) AS pos FROM walked WHERE goal IS NOT NULL GROUP BY target),
titles AS (SELECT pos, array_to_string(list_filter([trim(lower(english)), trim(lower(chinese))], lambda x: x <> ''), ' / ') AS title FROM idx),
placed AS (SELECT target, a, b, pos, title, instr(title, a) AS p1, instr(substr(title, instr(title, a) + length(a)), b) AS p2 FROM two JOIN titles ON contains(title, a) AND contains(title, b)),
scored AS (SELECT target, pos, p1 + length(a) + p2 - 2 AS last, a, b, title, p1 FROM placed WHERE p2 > 0),
points AS (SELECT target, pos, CASE WHEN last < CASE WHEN contains(title, ' see ') THEN instr(title, ' see ') - 1 ELSE length(title) END THEN 100 ELSE 0 END + CASE WHEN last = 0 THEN 50 ELSE 0 END
  + CASE WHEN starts_with(title, a) THEN 30 ELSE 0 END + CASE WHEN starts_with(title, b) THEN 20 ELSE 0 END + CASE WHEN last <= p1 - 1 + length(a) + 20 THEN 10 ELSE 0 END AS score FROM scored),
ordered AS (SELECT target, pos FROM points QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, pos) = 1),
tail_code AS (SELECT target, pos FROM targets JOIN idx ON NOT contains(target, ',') AND regexp_extract(target, '(\d+(?:\.\d+)?)$', 1) <> '' AND lower(code) = regexp_extract(target, '(\d+(?:\.\d+)?)$', 1))"""


def _rows(spark, d):
    part = F.regexp_extract("source_file", r"-(\d+)-\d+\.csv$", 1).cast("int")
    return view(spark, d, "idx").withColumn("part", part)


def _targets(rows):
    return R.targets_of(R.followable(R.references(rows)))


def extract_refs(spark, d):
    return R.references(_rows(spark, d))


def followable_refs(spark, d):
    return R.followable(R.references(_rows(spark, d)))


def ref_spans(spark, d):
    """Places of the followable targets in `zh / en` titles; where only the Chinese text is shown, English targets are behind it."""
    rows = _rows(spark, d)
    refs = R.followable(R.references(rows)).groupBy("pos").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    title = F.concat_ws(" / ", *[F.when(F.col(c) != "", F.col(c)) for c in ("chinese", "english")])
    title = F.when(F.col("pos") % 3 == 0, F.col("chinese")).otherwise(title)
    spans = rows.join(refs, "pos").select("pos", F.explode(reference_spans(title, F.col("targets"))).alias("s"))
    return spans.select("pos", "s.start", "s.end", "s.target")


def term_index(spark, d):
    return R.term_index(_rows(spark, d))


def locate_exact(spark, d):
    rows = _rows(spark, d)
    return R.locate_exact(rows, _targets(rows))


def locate_prefix(spark, d):
    rows = _rows(spark, d)
    return R.locate_prefix(rows, _targets(rows))


def locate_path(spark, d):
    rows = _rows(spark, d)
    return R.locate_path(rows, _targets(rows), "part")


def locate_ordered(spark, d):
    rows = _rows(spark, d)
    return R.locate_ordered(rows, _targets(rows))


def locate_trailing_code(spark, d):
    rows = _rows(spark, d)
    return R.locate_trailing_code(rows, _targets(rows))


def resolve_references(spark, d):
    rows = _rows(spark, d)
    return R.resolve(rows, R.targets_of(R.references(rows)), "part")


#: The rows before and after edits of some pages: rows gone, new, at another level, with another text or code. The texts run on both sides.
BEFORE = "SELECT pos, page, level, chinese, english, code, source_file, source_line FROM idx WHERE NOT (page % 11 = 3 AND pos % 9 = 2)"
AFTER = """SELECT pos, page, CASE WHEN page % 11 = 3 AND pos % 9 = 4 THEN level + 1 WHEN page % 11 = 3 AND pos % 9 = 5 THEN 1 ELSE level END AS level, chinese,
 CASE WHEN page % 11 = 3 AND pos % 9 = 7 THEN concat('graft of ', english) ELSE english END AS english,
 CASE WHEN page % 11 = 3 AND pos % 9 = 8 THEN '' ELSE code END AS code, source_file, source_line
FROM idx WHERE NOT (page % 11 = 3 AND pos % 9 = 1)"""


def _edition(rows, text):
    return rows.sparkSession.sql(text.replace("FROM idx", "FROM {idx}"), idx=rows).join(rows.select("pos", "part"), "pos")


def resolve_again(spark, d):
    """References after edits of some pages, from those before."""
    before, after = (spread(_edition(_rows(spark, d), text), "pos", "edition") for text in (BEFORE, AFTER))
    found = written(R.resolve(before, R.targets_of(R.references(before)), "part"), "resolved")
    return R.resolve_again(before, after, found, R.targets_of(R.references(after)), "part")


def _deep_targets(rows):
    """Targets of three parts: two English words and the Chinese text, in two orders, and those with a part that is nowhere."""
    a, b, c = F.split_part("english", F.lit(" "), F.lit(1)), F.split_part("english", F.lit(" "), F.lit(2)), F.replace("chinese", F.lit("术"), F.lit(""))
    three = lambda *parts: F.concat_ws(", ", *parts)
    kinds = F.when(F.col("pos") % 3 == 0, three(a, b, c)).when(F.col("pos") % 3 == 1, three(a, c, b)).otherwise(three(a, b, F.lit("nowhere")))
    return rows.where("pos % 17 = 10").select(F.lower(kinds).alias("target")).distinct()


def locate_deep_path(spark, d):
    rows = _rows(spark, d)
    return R.locate_path(rows, _deep_targets(rows), "part")


def locate_deep_ordered(spark, d):
    rows = _rows(spark, d)
    return R.locate_ordered(rows, _deep_targets(rows))


QUERIES = {f.__name__: f for f in (locate_deep_path, locate_deep_ordered, extract_refs, followable_refs, ref_spans, term_index, locate_exact, locate_prefix, locate_path, locate_ordered, locate_trailing_code, resolve_references, resolve_again)}

RESOLVED = """stages AS (SELECT target, 'exact' AS stage, pos, 1 AS k FROM exact UNION ALL SELECT target, 'prefix', pos, 2 FROM prefix UNION ALL SELECT target, 'path', pos, 3 FROM path
  UNION ALL SELECT target, 'ordered', pos, 4 FROM ordered UNION ALL SELECT target, 'trailing_code', t.pos, 5 FROM tail_code t JOIN targets USING (target) WHERE NOT is_code),
best AS (SELECT target, min(k) AS k FROM stages GROUP BY target)
SELECT target, stage, pos FROM stages JOIN best USING (target, k)
UNION ALL SELECT target, 'ignored', NULL FROM ignored
UNION ALL SELECT target, 'none', NULL FROM targets WHERE target NOT IN (SELECT target FROM best)"""
SPANS = """told AS (SELECT pos, target, CASE WHEN pos % 3 = 0 THEN chinese ELSE array_to_string(list_filter([chinese, english], lambda x: x <> ''), ' / ') END AS title FROM refs JOIN idx USING (pos)
  WHERE NOT contains(lower(target), '亚目') AND NOT contains(lower(target), 'subcategory')),
spots AS (SELECT DISTINCT pos, target, CAST(instr(lower(title), lower(target)) - 1 AS INT) AS start, CAST(instr(lower(title), lower(target)) - 1 + length(target) AS INT) AS "end" FROM told WHERE instr(lower(title), lower(target)) > 0)
SELECT pos, start, "end", target FROM spots s WHERE NOT EXISTS (SELECT 1 FROM spots o WHERE o.pos = s.pos AND (o.start < s.start OR (o.start = s.start AND o."end" > s."end")) AND o."end" > s.start)
UNION ALL SELECT pos, CAST(length(any_value(title)) AS INT), CAST(length(any_value(title)) AS INT), min(target) FROM told WHERE pos NOT IN (SELECT pos FROM spots) GROUP BY pos"""
DEEP = """words AS (SELECT pos, split_part(lower(english), ' ', 1) AS a, split_part(lower(english), ' ', 2) AS b, replace(lower(chinese), '术', '') AS c FROM idx WHERE pos % 17 = 10),
deep AS (SELECT DISTINCT CASE pos % 3 WHEN 0 THEN [a, b, c] WHEN 1 THEN [a, c, b] ELSE [a, b, 'nowhere'] END AS parts FROM words),
three AS (SELECT array_to_string(parts, ', ') AS target, parts[1] AS a, parts[2] AS b, parts[3] AS c FROM deep),
heads3 AS (SELECT DISTINCT target, b, c, pos FROM three JOIN terms ON term = a OR (starts_with(term, a) AND contains(' ,-/()—', substr(term, length(a) + 1, 1)))),
step2 AS (SELECT h.target, h.c, h.pos AS head, coalesce((SELECT min(t.pos) FROM terms t WHERE t.pos > h.pos AND t.pos < e.stop AND contains(t.term, h.b)), (SELECT min(t.pos) FROM terms t WHERE t.pos = h.pos AND contains(t.term, h.b))) AS at2
  FROM heads3 h JOIN row_ends e ON e.pos = h.pos),
step3 AS (SELECT s.target, s.head, coalesce((SELECT min(t.pos) FROM terms t WHERE t.pos > s.at2 AND t.pos < e.stop AND contains(t.term, s.c)), (SELECT min(t.pos) FROM terms t WHERE t.pos = s.at2 AND contains(t.term, s.c))) AS goal
  FROM step2 s JOIN row_ends e ON e.pos = s.at2),
placed3 AS (SELECT target, a, c AS z, pos, title, instr(title, a) AS p1, instr(title, a) + length(a) AS n1, b, c FROM three JOIN titles ON contains(title, a) AND contains(title, b) AND contains(title, c)),
second3 AS (SELECT *, instr(substr(title, n1), b) AS p2 FROM placed3), third3 AS (SELECT *, n1 + p2 - 1 + length(b) AS n2 FROM second3 WHERE p2 > 0),
last3 AS (SELECT *, n2 + instr(substr(title, n2), c) - 2 AS last FROM third3 WHERE instr(substr(title, n2), c) > 0),
points3 AS (SELECT target, pos, CASE WHEN last < CASE WHEN contains(title, ' see ') THEN instr(title, ' see ') - 1 ELSE length(title) END THEN 100 ELSE 0 END + CASE WHEN last = 0 THEN 50 ELSE 0 END
  + CASE WHEN starts_with(title, a) THEN 30 ELSE 0 END + CASE WHEN starts_with(title, z) THEN 20 ELSE 0 END + CASE WHEN last <= p1 - 1 + length(a) + 20 THEN 10 ELSE 0 END AS score FROM last3)"""

ORACLE_SQL = {
    name: with_views(f"{REFS} {select}" if select.startswith("SELECT") else f"{REFS}, {select}", "idx")
    for name, select in {
        "extract_refs": "SELECT pos, lang, kind, target FROM refs",
        "followable_refs": "SELECT pos, lang, kind, target FROM refs WHERE NOT contains(lower(target), '亚目') AND NOT contains(lower(target), 'subcategory')",
        "ref_spans": SPANS,
        "locate_deep_path": f"{DEEP} SELECT target, arg_min(goal, head) AS pos FROM step3 WHERE goal IS NOT NULL GROUP BY target",
        "locate_deep_ordered": f"{DEEP} SELECT target, pos FROM points3 QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, pos) = 1",
        "term_index": "SELECT term, lang, pos FROM terms WHERE term <> ''",
        "locate_exact": "SELECT target, pos FROM exact",
        "locate_prefix": "SELECT target, pos FROM prefix",
        "locate_path": "SELECT target, pos FROM path",
        "locate_ordered": "SELECT target, pos FROM ordered",
        "locate_trailing_code": "SELECT target, pos FROM tail_code",
        "resolve_references": RESOLVED,
    }.items()
}
ORACLE_SQL["resolve_again"] = with_views(re.sub(r"\bidx\b", "after_edits", f"{REFS}, {RESOLVED}").replace("found AS", f"after_edits AS ({AFTER}), found AS", 1), "idx")

"""URL filters with redirect equivalence. DataFrame functions only.

Rules give block or allow by host and path prefix. Pages that no rule fits take the verdict of their equivalence
class: connected components over redirect (meta refresh) and canonical-link edges. An explicit allow in a class goes
before any block in it; a class without rules allows.

Pages are told apart by their url without scheme and fragment, query string included; rules look at host and path only.

Null urls and urls without `://` have an empty host and path, no rule, and are allowed. Null html has no edges.
Repeated urls share their class; other columns of the input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import ascii_lower, connected_components, saved

#: (verdict, host, path prefix); a rule fits its host and all subdomains.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The query string with its `?`, empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What tells pages apart: host, path and query string."""
    return F.concat(host_of(url), path_of(url), query_of(url))


def judged(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _links(html: Column) -> Column:
    """Targets of canonical links and meta refreshes, as they stand in the markup."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), 0)
    href = lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    goal = lambda t: F.regexp_extract(t, r"(?i)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*'?([^\"'\s>]+)", 1)
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<link\b[^>]*\brel\s*=\s*[\"']?canonical\b")), href)
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b")), goal)
    return F.filter(F.concat(canonical, refresh), lambda t: t != "")


def _absolute(link: Column, scheme: Column, host: Column, path: Column, query: Column) -> Column:
    base = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path, link))
        .when(link.startswith("#"), F.concat(base, path, query, link))
        .otherwise(F.concat(base, F.regexp_replace(F.concat(F.lit("/"), path), r"^/+([\s\S]*/)?[^/]*$", "/$1"), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): the page's key, and that of the page it names as canonical or redirects to."""
    hinted = pages.where("url is not null and html is not null").where(F.col("html").rlike(r"(?i)canonical|refresh"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    links = hinted.select(host.alias("host"), path.alias("path"), query_of(F.col("url")).alias("query"), F.regexp_extract("url", r"^([\s\S]*?)://", 1).alias("scheme"), F.explode(_links(F.col("html"))).alias("link"))
    to = links.where("scheme <> ''").select(F.concat("host", "path", "query").alias("a"), _absolute(F.col("link"), F.col("scheme"), F.col("host"), F.col("path"), F.col("query")).alias("to"))
    return to.select("a", key_of(F.col("to")).alias("b")).where("a <> '' and b <> '' and a <> b")


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url, html)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"), key_of(F.col("url")).alias("key"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    out = out.select("page_id", "host", "path", "key", rule.alias("rule"), verdict.alias("by_rule"))
    edges = saved(alias_edges(pages).distinct(), "aliases")
    if edges.isEmpty():
        return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"))
    nodes = connected_components(edges)
    split = nodes.select("component", "node", F.regexp_extract("node", r"^[^/?]*", 0).alias("h"), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("p"))
    known = split.select("component", "node", judged(F.col("h"), F.col("p"), rules)[1].alias("v"))
    classes = known.groupBy("component").agg(F.max(F.coalesce(F.col("v") == "allow", F.lit(False))).alias("allows"), F.max(F.coalesce(F.col("v") == "block", F.lit(False))).alias("blocks"))
    by_node = nodes.join(classes, "component").select(F.col("node").alias("key"), F.when(F.col("blocks") & ~F.col("allows"), "block").otherwise("allow").alias("by_class"))
    return (
        out.join(by_node, "key", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_class", F.lit("allow")).alias("verdict"))
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The tables hold no canonical links or refreshes; where they do, tests compare the classes with brute force.
OP10_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS place FROM pages
), r AS (
  SELECT page_id, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM r
), p AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h
), f AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""

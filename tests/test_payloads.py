"""Answers as JSON: pages of codes, references and nodes."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from stemma.operators import codes
from stemma.sources import batches, payloads


def test_page_look_ups(spark):
    raw = spark.createDataFrame([(21, "01.2", None), (21, "01.20", "range"), (22, " 02.5 ", ""), (23, "9x", ""), (24, "03", "row"), (25, "02.50", "row"), (26, "04.1", "a"), (26, "04.1", "b")] + [(100 + i, "07.7", "") for i in range(15)], "page int, code string, row_type string")
    asked = [("exact", "02.5"), ("typed", " 0 2.5　"), ("near", "02.9"), ("later", "99.99"), ("first", "00.1"), ("text", "Repair"), ("blank", "  "), ("null", None), ("types", "04.1"), ("many", "07.7"), ("again", "02.9")]
    got = {r["query_id"]: json.loads(r["payload"]) for r in payloads.page_payload(spark.createDataFrame(asked, "query_id string, query string"), batches.code_pages(raw)).collect()}
    none = {"count": 0, "rows": [], "page": None}
    assert got["exact"] == {"query": "02.5", "count": 1, "rows": [{"page": 22, "code": "02.5", "row_type": ""}], "page": 22}
    assert got["typed"] == got["exact"] | {"query": "0 2.5"}
    # keys 02.5 and 02.50 are one, on two pages: the earlier counts, with its own code
    assert got["near"] == got["again"] == {"query": "02.9", "count": 1, "rows": [{"page": 22, "code": "02.5", "row_type": "page_boundary"}], "page": 22}
    assert got["later"]["rows"] == [{"page": 100, "code": "07.7", "row_type": "page_boundary"}]
    assert got["first"] == none | {"query": "00.1"} and got["text"] == none | {"query": "Repair"} and got["blank"] == got["null"] == none | {"query": ""}
    assert [r["row_type"] for r in got["types"]["rows"]] == ["a", "b"]
    assert got["many"]["count"] == 10 and [r["page"] for r in got["many"]["rows"]] == list(range(100, 110))
    assert codes.page_hits(raw.limit(0).withColumn("code", F.lit("1")), batches.code_pages(raw)).collect() == []


ROWS = [
    (0, 1, 0, "", "R", ""), (1, 1, 1, "修补", "Repair", ""), (2, 1, 2, "", "hip -see Joint", "81.4"), (3, 1, 3, "", "left", "81.40"), (4, 1, 1, "", "Joint", ""),
    (5, 2, 2, "", "hip", "81.5"), (6, 2, 1, "", "Zone, see subcategory 3", ""), (7, 2, 0, "", "S", ""), (8, 2, 2, "", "hip", "81.6"),
]


def frame(spark):
    rows = [(p, page, page, level, zh, en, code, "f.csv", p) for p, page, level, zh, en, code in ROWS]
    return spark.createDataFrame(rows, "pos bigint, part int, page int, level int, chinese string, english string, code string, source_file string, source_line int")


def told(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["query_id"], r["kind"]), {})[r["block"]] = json.loads(r["payload"])
    return out


def test_references_are_located(spark):
    asked = spark.createDataFrame([(1, " Joint "), (2, "JOINT"), (3, "subcategory 3"), (4, ""), (5, "nothing"), (6, "Repair, left"), (7, None), (8, "81.4"), (9, "hip")], "query_id int, query string")
    got = told(payloads.locate_payload(asked, frame(spark), "part", block_rows=2))
    assert {k for k in got} == {(i, k) for i in range(1, 10) for k in ("rows", "tree")}
    [one] = got[1, "rows"].values()
    assert one["query"] == "Joint" and one["count"] == 1 and one["rows"][0]["english"] == "Joint" and one["rows"][0]["matched"] and "ignored" not in one
    assert got[2, "rows"][0] == one | {"query": "JOINT"}
    assert got[3, "rows"] == {0: {"query": "subcategory 3", "count": 0, "rows": [], "ignored": True}}
    assert got[4, "rows"] == got[7, "tree"] == {0: {"query": "", "count": 0, "rows": []}} and got[5, "tree"][0]["count"] == 0
    assert [r["english"] for r in got[6, "rows"][0]["rows"]] == ["left"]
    tree = got[6, "tree"]
    assert [(r["english"], r["matched"], r["parent_id"]) for b in sorted(tree) for r in tree[b]["rows"]] == [("Repair", False, None), ("hip -see Joint", False, "1-1-f.csv-1"), ("left", True, "1-2-f.csv-2")]
    assert [len(tree[b]["rows"]) for b in sorted(tree)] == [2, 1] and {b["count"] for b in tree.values()} == {3}
    assert got[8, "rows"][0]["rows"][0]["references"] == [{"kind": "see", "target": "Joint"}]
    # a prefix that two letters' rows begin with; a row right below a letter hangs below an earlier letter's row
    assert sorted(r["source_line"] for b in got[9, "rows"].values() for r in b["rows"]) == [5, 8]
    unmarked = told(payloads.locate_payload(asked, frame(spark), "part", mark=False))
    assert not any(r["matched"] for a in unmarked.values() for b in a.values() for r in b["rows"]) and len(unmarked[6, "tree"][0]["rows"]) == 3


def test_children_of_nodes(spark):
    asked = spark.createDataFrame([("a", "1-1-f.csv-1"), ("b", "1-1-f.csv-1"), ("leaf", "2-2-f.csv-8"), ("lost", "9-9-f.csv-9"), ("letter", "1-0-f.csv-0")], "query_id string, id string")
    got = {}
    for r in payloads.children_payload(asked, frame(spark), "part", "HIP").collect():
        got.setdefault(r["query_id"], []).extend(json.loads(r["payload"])["children"])
    assert [(r["english"], r["matched"], r["parent_id"], r["has_children"]) for r in got["a"]] == [("hip -see Joint", True, None, True), ("left", False, "1-2-f.csv-2", False)]
    assert got["b"] == got["a"] and got["leaf"] == got["lost"] == [] and len(got["letter"]) == 6


def test_only_given_nodes_are_known(spark):
    """An id of a row that is no node is unknown, as is one of no row."""
    rows = frame(spark)
    asked = spark.createDataFrame([("a", "1-1-f.csv-1"), ("b", "1-2-f.csv-2"), ("c", "1-1-f.csv-10")], "query_id string, id string")
    rows = rows.withColumn("page", F.lit(1))
    count = lambda **kw: {r["query_id"]: len(json.loads(r["payload"])["children"]) for r in payloads.children_payload(asked, rows, "part", **kw).collect()}
    assert count() == {"a": 2, "b": 1, "c": 0}
    assert count(nodes=rows.where("level <= 1")) == {"a": 2, "b": 0, "c": 0}


def test_blocks_go_to_as_many_tasks_as_their_rows_need(spark, monkeypatch, capsys):
    asked = spark.createDataFrame([(1, "Joint"), (2, "81"), (3, "nothing"), (4, "hip")], "query_id int, query string")
    one = payloads.locate_payload(asked, frame(spark), "part", block_rows=1).collect()
    monkeypatch.setattr(batches, "TASK_ROWS", 1)
    many = payloads.locate_payload(asked, frame(spark), "part", block_rows=1)
    many.explain()
    tasks = {int(n) for n in re.findall(r"hashpartitioning\(query_id#\d+, kind#\d+, block#\d+, (\d+)\), REPARTITION_BY_NUM", capsys.readouterr().out)}
    # one for each row of the answers and one more
    assert tasks == {sum(len(json.loads(r["payload"])["rows"]) for r in one) + 1}
    assert sorted(many.collect()) == sorted(one)

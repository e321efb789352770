"""The index of pieces against plain search."""

from __future__ import annotations

import random

from stemma.operators import pieces, references, search


def test_all_needles_are_found(spark):
    r = random.Random(6)
    letters = "abc 术é"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 30))) for _ in range(120)]
    needles = {"".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(300)} | {t[2:9] for t in texts} | {"zzz", "abz", "aaaa", "z"}
    index = pieces.index_texts(spark.createDataFrame(list(enumerate(texts)), "pos bigint, _text string"), 3)
    got = pieces.holding(index, spark.createDataFrame([(n,) for n in needles] * 2 + [("",)], "_needle string"))
    assert sorted(map(tuple, got.collect())) == sorted((n, i) for n in needles if n for i, t in enumerate(texts) if n in t)


def test_postings_are_not_moved(spark):
    """Probes go to the buckets: no exchange stands above a scan of the postings."""
    index = pieces.index_texts(spark.createDataFrame([(1, "some text")], "pos bigint, _text string"), 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        needles = spark.createDataFrame([("me te",)], "piece string")
        plan = needles.join(index.postings, "piece")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_and_paths_by_the_index_find_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i // 4, i % 3, f"甲{i % 5}", f"{w} of {v}, left", f"{i:02d}.1", "f", i) for i, (w, v) in enumerate([(w, v) for w in ("repair", "excision", "bone") for v in ("hip", "hand", "repair")])], "pos bigint, part int, level int, chinese string, english string, code string, source_file string, source_line int")
    queries = spark.createDataFrame([(1, "repair", "auto"), (2, "hip  hand", "any"), (3, "甲1 re", "phrase"), (4, "of", "auto"), (5, "nothing", "auto")], "query_id int, query string, mode string")
    plain = sorted(map(tuple, search.search_texts(rows, queries).collect()))
    assert sorted(map(tuple, search.search_texts(rows, queries, index=search.text_index(rows)).collect())) == plain and len(plain) > 10
    targets = spark.createDataFrame([("repair, hand",), ("repair, bone",), ("excision of hip, hand, left",), ("bone, 甲",)], "target string")
    want = sorted(map(tuple, references.locate_path(rows, targets, "part").collect()))
    monkeypatch.setattr(references, "SENT_QUERIES", 0)
    assert sorted(map(tuple, references.locate_path(rows, targets, "part").collect())) == want != []


def test_texts_of_many_rows_are_cut_once(spark):
    texts = ["red ring", "blue bolt", "red ring"] * 20
    index = pieces.index_texts(spark.createDataFrame(list(enumerate(texts)), "pos bigint, _text string"), 3)
    assert index.texts.count() == 2 and index.postings.where("piece = 'red'").count() == 1
    needles = spark.createDataFrame([("ring",), ("d r",), ("bolt",), ("none",)], "_needle string")
    want = sorted((n, i) for n in ("ring", "d r", "bolt") for i, t in enumerate(texts) if n in t)
    assert sorted(map(tuple, pieces.holding(index, needles).collect())) == want

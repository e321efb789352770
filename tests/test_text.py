"""Column functions on hand-written cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text as T


def one(spark, expr, **cells):
    names = ", ".join(f"{k} string" for k in cells)
    return spark.createDataFrame([tuple(cells.values())], names).select(expr.alias("x")).first()["x"]


def test_strip_takes_all_white_space(spark):
    assert one(spark, T.strip("a"), a="　 \x1c\t\xa0x y\x1f \n") == "x y"


def test_parse_int(spark):
    cases = {"3.9": 3, "-3.9": -3, "": 7, None: 7, "nan": 7, "inf": 7, "1e2": 100, "1d": 7, " 5 ": 5, "　8": 8, "-1": -1, "1e400": 7, "+5.": 5, ".5": 0, "x": 7}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", T.parse_int("a", 7).alias("n")).collect()
    assert {r["a"]: r["n"] for r in rows} == cases


def test_parse_text_tests_nan_before_it_strips(spark):
    rows = spark.createDataFrame([("nan",), (" nan",), (None,), ("NaN",), ("　见 ",)], "a string").select(T.parse_text("a").alias("t")).collect()
    assert [r["t"] for r in rows] == ["", "nan", "", "", "见"]


def test_code_keys(spark):
    cases = {"00": 0, "00.0": 1, "00.4": 41, "00.40": 41, "5": 5000, "123": None, "57.87[45.51]": None, "89.45-89.49": None, "": None, "99.99": 99100}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", T.code_key("a").alias("k")).collect()
    assert {r["a"]: r["k"] for r in rows} == cases
    assert one(spark, T.normalize_code("a"), a=" 00.94　[89.14]\n") == "00.94[89.14]"


def test_references(spark):
    df = spark.createDataFrame([("常见", "a-see B; See also  C", 1), ("甲-另见乙；见 丙", "seen it", 2), ("", "", 3)], "chinese string, english string, i int")
    found = {r["i"]: [tuple(x) for x in r["r"]] for r in df.select("i", T.extract_references().alias("r")).collect()}
    assert found == {1: [("en", "see", "B"), ("en", "see also", "C")], 2: [("zh", "另见", "乙"), ("zh", "见", "丙")], 3: []}


def test_followed(spark):
    df = spark.createDataFrame([("x",), ("",), ("Subcategory 1",), ("某亚目",)], "t string")
    assert [r[0] for r in df.select(T.followed(F.col("t"))).collect()] == [True, False, False, False]


def test_reference_spans_do_not_overlap(spark):
    df = spark.createDataFrame([("abc / See Abcd", ["abcd", "ABC", "bc", "zz"])], "title string, t array<string>")
    spans = df.select(T.reference_spans(F.col("title"), F.col("t")).alias("s")).first()["s"]
    assert [(s["start"], s["end"], s["target"]) for s in spans] == [(0, 3, "ABC"), (10, 14, "abcd")]
    df = spark.createDataFrame([("abc", ["x", "y"]), ("abc", [])], "title string, t array<string>")
    assert [[tuple(s) for s in r["s"]] for r in df.select(T.reference_spans(F.col("title"), F.col("t")).alias("s")).collect()] == [[(3, 3, "x")], []]


def test_csv_line(spark):
    df = spark.createDataFrame([(1, 2, '甲"', "a,b", "1,2"), (1, 0, "", "", "")], "page int, level int, chinese string, english string, code string")
    assert [r[0] for r in df.select(T.csv_line()).collect()] == ['1,2,"甲""","a,b","1,2"', '1,0,"","",']


def test_tree_preview(spark):
    df = spark.createDataFrame([(2, "x"), (-1, "y")], "level int, chinese string")
    assert [r[0] for r in df.select(T.tree_preview()).collect()] == ["　　x", "y"]

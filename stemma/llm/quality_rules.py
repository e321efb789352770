"""Quality rules by weak supervision. DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns
estimates each rule's accuracy and the share of good documents; a document's posterior probability of being good
then decides, in place of "all rules must pass". There are at most 3^10 patterns, whatever the input's size, so the
whole estimation runs inside one row.

Null and empty texts have zero words, fail the base rules and are not kept. Repeated rows count each time; a row is
judged by its text alone, so null and repeated doc_ids need no rule. An empty table gives no rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import WORD, documents, let, saved

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def _count(c: Column, chars: str) -> Column:
    return (F.length(c) - F.length(_without(c, chars))).cast("long")


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words that lie in a window of `width` words found twice or more in the array, the first time included."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.slice(words, i + 1, width)))

    def covered(h: Column) -> Column:
        # windows by (hash, position); those with an equal neighbour repeat
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, a, b: F.coalesce(F.try_element_at(s, a)["h"] == F.try_element_at(s, b)["h"], F.lit(False))
        twice = let(ranked, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (F.when(k > 0, same(s, k, k + 1)).otherwise(False) | same(s, k + 1, k + 2)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct((i + width).alias("end"), (acc["n"] + (i + width - F.greatest(i, acc["end"]))).alias("n"))
        return F.aggregate(twice, start, step, lambda acc: acc["n"])

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(n > width, some).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules look at, for each row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
    of_words = let(
        F.regexp_extract_all(text, F.lit(WORD), 0),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select(
        "doc_id",
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, "!").alias("n_bangs"),
        _count(text, ".").alias("n_stops"),
        _count(text, UPPER).alias("n_upper"),
        of_words.alias("w"),
        of_lines.alias("l"),
    )
    return out.select("doc_id", "word_chars", "n_symbols", "n_bangs", "n_stops", "n_upper", "w.*", "l.*")


def votes() -> list[Column]:
    """One column for each rule: 1 good, -1 bad, 0 abstains."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))

    def low_is_good(x: Column, good: float, bad: float) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(x > bad, -1).when(x < good, 1).otherwise(0)

    mean = share("word_chars", "n_words")
    distinct = share("n_distinct_words", "n_words")
    stops = share("n_stops", "n_words")
    marks = (F.col("n_symbols") + F.col("n_bangs") + F.col("n_stops")) / F.greatest(F.col("word_chars"), F.lit(1))
    return [
        low_is_good(share("n_symbols", "n_words"), 0.05, 0.3),
        low_is_good(share("n_symbols", "word_chars"), 0.01, 0.05),
        low_is_good(marks, 0.06, 0.1),
        low_is_good(share("n_bangs", "n_words"), 0.05, 0.3),
        low_is_good(share("n_upper", "word_chars"), 0.1, 0.3),
        low_is_good(share("n_repeat_words", "n_words"), 0.1, 0.3),
        low_is_good(share("n_dup_lines", "n_lines"), 0.05, 0.3),
        F.when(F.col("n_words") < 50, 0).when(distinct < 0.1, -1).when(distinct > 0.2, 1).otherwise(0),
        F.when(F.col("n_words") == 0, 0).when((mean < 2) | (mean > 15), -1).when((mean > 3) & (mean < 9), 1).otherwise(0),
        F.when(F.col("n_words") < 30, 0).when(stops < 0.01, -1).when(stops > 0.02, 1).otherwise(0),
    ]


#: First guess of the shares of votes (bad, abstain, good) for bad and for good documents; it counts as much as PRIOR documents of each class.
START_BAD, START_GOOD, PRIOR = (0.4, 0.2, 0.4), (0.02, 0.28, 0.7), 10.0


def estimate(voted: DataFrame, n_rules: int, rounds: int = 25) -> tuple[float, list[list[float]]]:
    """(share of good documents, for each rule the log odds that its votes bad, abstain and good speak for good).

    Expectation-maximisation over the vote patterns: a rule's accuracy is its shares of votes for good and for bad
    documents, so a vote that good documents hardly ever get weighs more than one that most documents get.
    """
    patterns = voted.groupBy("v").agg(F.count("*").cast("double").alias("n"))
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"))
    total = lambda ps, f: F.aggregate(ps, F.lit(0.0), lambda a, p: a + f(p))

    def step(s: Column, _: Column) -> Column:
        def posterior(p: Column) -> Column:
            z = F.log(s["good"] / (1 - s["good"])) + F.aggregate(F.zip_with(p["v"], s["odds"], lambda v, w: F.element_at(w, v + 2)), F.lit(0.0), lambda a, b: a + b)
            return F.struct(p["v"].alias("v"), p["n"].alias("n"), (1 / (1 + F.exp(-z))).alias("q"))

        def renewed(ps: Column) -> Column:
            n_good, n_all = total(ps, lambda p: p["n"] * p["q"]), total(ps, lambda p: p["n"])

            def odds(j: int, vote: int) -> Column:
                mine = lambda p, x: F.when(p["v"][j] == vote, x).otherwise(0.0)
                of_good, of_all = total(ps, lambda p: mine(p, p["n"] * p["q"])), total(ps, lambda p: mine(p, p["n"]))
                return F.log((of_good + PRIOR * START_GOOD[vote + 1]) / (n_good + PRIOR)) - F.log((of_all - of_good + PRIOR * START_BAD[vote + 1]) / (n_all - n_good + PRIOR))

            good = F.least(F.lit(0.99), F.greatest(F.lit(0.01), (n_good + 1) / (n_all + 2)))
            return F.struct(good.alias("good"), F.array(*[F.array(*[odds(j, v) for v in (-1, 0, 1)]) for j in range(n_rules)]).alias("odds"))

        return let(F.transform(F.col("p"), posterior), renewed)

    first = F.array(*[F.lit(log(g / b)) for g, b in zip(START_GOOD, START_BAD)])
    start = F.struct(F.lit(0.8).cast("double").alias("good"), F.array_repeat(first, n_rules).alias("odds"))
    found = gathered.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s")).first()["s"]
    return found["good"], [list(w) for w in found["odds"]]


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: base figures, base_failed, posterior and kept."""
    rules = votes()
    voted = saved(features(docs).withColumn("v", F.array(*[r.cast("int") for r in rules])), "votes")
    good, odds = estimate(voted, len(rules))
    z = F.lit(log(good / (1 - good)))
    for j, w in enumerate(odds):
        z = z + F.element_at(F.array(*[F.lit(x) for x in w]), F.col("v")[j] + 2)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (1 / (1 + F.exp(-z))).alias("posterior"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))

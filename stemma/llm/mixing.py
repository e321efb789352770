"""Mixing sources to target weights by cube-method balanced sampling.

A source's documents are all due target / size copies on average. The whole part is given to each; the fraction is an
inclusion probability. The flight phase moves the probabilities of a block along the null space of two constraints (the
source's token total and document total), in the direction that moves the longest open document most, until one of them
is 0 or 1. It runs in blocks of bounded size, each of which leaves at most two documents undecided; these meet in fewer
blocks at the next level, until one block a source is left. There the flight stops when LAST documents are open. They
land by a linear programme over those of their subsets that miss the document total by less than one and the source's
target by NEAR of it at most (the nearest one, if none does): the design that changes inclusion probabilities least, and
of such designs the one of least expected squared miss of the token total, is drawn from. So documents of sources with
many more than LAST keep their probabilities; where a few long ones make the source, its total goes before them.

Null texts have size 0. A null source is a source of its own, the last in order. Repeated rows are drawn one by one.
Draws depend on doc_id, text and source only, so reruns agree. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.common import WORD, documents, row_keys, saved, unused

#: Rows in a block of the flight phase.
BLOCK = 1024
#: Open documents of a source that land together, out of 2 ** LAST subsets.
LAST = 12
#: Part of its target that a source may miss while probabilities are kept.
NEAR = 0.005
#: Price of a changed probability, beside that of a squared miss in longest documents.
CHANGED = 1e4
#: Repeats of one row that are counted out at a time.
REPEATS = 100_000


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, n_rows, source_size, target) from (source, size, rows), rows being how many are alike: weights repeat over the ordered sources.

    Water level L solves sum(min(cap * size, L * weight)) = share * all sizes: what resharing the excess ends in.
    Its windows run over one row for each source.
    """
    s = sized.groupBy("source").agg(F.sum("rows").alias("n_rows"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    ranked = s.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy().orderBy("full", "k")
    ahead, whole = everything.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = ranked.withColumn("full", cap * F.col("source_size") / F.col("w"))
    top = top.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap * F.col("source_size")).over(ahead), F.lit(0.0))) / F.sum("w").over(everything.rowsBetween(0, Window.unboundedFollowing)))
    top = top.withColumn("level", F.first(F.when(F.col("level") <= F.col("full"), F.col("level")), ignorenulls=True).over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return top.select("source", "n_rows", "source_size", F.when(F.col("level").isNull() | (F.col("level") * F.col("w") > cap * F.col("source_size")), cap * F.col("source_size")).otherwise(F.col("level") * F.col("w")).cast("double").alias("target"))


def land(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, near: float = np.inf) -> np.ndarray:
    """0 or 1 for each of a few open documents: a draw from the best design over subsets that miss the words due by `near` at most.

    A design gives each subset a chance. Its chances of document k and p[k] differ by what two more columns take, at a
    price. The simplex method starts from the nearest subset alone; where it ends, the chances are those drawn from.
    """
    m = len(p)
    if not m:
        return p.copy()
    subsets = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    words = subsets @ size - size @ p
    whole = np.abs(subsets.sum(1) - p.sum()) < 1 - 1e-9
    allowed = whole & (np.abs(words) <= max(near, np.abs(words[whole]).min()))
    subsets, words = subsets[allowed], words[allowed]
    n, nearest = len(subsets), int(np.abs(words).argmin())
    columns = np.hstack([np.vstack([subsets.T, np.ones(n)]), np.vstack([np.hstack([np.eye(m), -np.eye(m)]), np.zeros(2 * m)])])
    due = np.append(p, 1.0)
    cost = np.concatenate([(words / max(1.0, size.max())) ** 2, np.full(2 * m, CHANGED)])
    basis = np.append(n + np.arange(m) + m * (subsets[nearest] > 0), nearest)
    for step in range(10_000):
        chosen = columns[:, basis]
        reduced = cost - np.linalg.solve(chosen.T, cost[basis]) @ columns
        better = np.flatnonzero(reduced < -1e-7)
        if not len(better):
            break
        # the steepest first; the first of all, which cannot cycle, when that has not ended
        enters = better[0] if step > 500 else reduced.argmin()
        chance, change = np.linalg.solve(chosen, due), np.linalg.solve(chosen, columns[:, enters])
        ratio = np.where(change > 1e-9, np.maximum(chance, 0) / np.where(change > 1e-9, change, 1), np.inf)
        tied = np.flatnonzero(ratio <= ratio.min() + 1e-12)
        basis[tied[basis[tied].argmin()]] = enters
    chance = np.where(basis < n, np.maximum(np.linalg.solve(columns[:, basis], due), 0), 0).cumsum()
    return subsets[basis[int((chance > rng.random() * chance[-1] * (1 - 1e-12)).argmax())]]


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, last: bool = False, near: float = np.inf) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping sum(p) and sum(size * p); at most two stay open. If last, the last LAST land instead."""
    p, eps = p.astype(float).copy(), 1e-9
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    free = np.flatnonzero((p > 0) & (p < 1))
    free = free[np.argsort(-size[free], kind="stable")]
    while (m := len(free)) > (LAST if last else 0):
        z = size[free] - size[free].mean()
        # what is left of each unit vector in the null space of (1, size); the first one's is taken unless nothing is left
        scale = z @ z
        left = 1 - 1 / m - (z * z / scale if scale else np.zeros(m))
        k = 0 if left[0] > 1e-6 else int(left.argmax())
        if left[k] <= 1e-9:
            break
        u = -1 / m - (z * (z[k] / scale) if scale else np.zeros(m))
        u[k] += 1
        q = p[free]
        with np.errstate(divide="ignore", invalid="ignore"):
            ahead, behind = np.where(u > 0, (1 - q) / u, -q / u), np.where(u > 0, q / u, -(1 - q) / u)
        ahead, behind = np.where(np.abs(u) > 1e-12, ahead, np.inf), np.where(np.abs(u) > 1e-12, behind, np.inf)
        up, down = int(ahead.argmin()), int(behind.argmin())
        forward = rng.random() * (ahead[up] + behind[down]) < behind[down]
        at, t = (up, ahead[up]) if forward else (down, -behind[down])
        q = q + t * u
        q[at] = float((u[at] > 0) == forward)
        q[q <= eps], q[q >= 1 - eps] = 0.0, 1.0
        p[free] = q
        free = free[(q > 0) & (q < 1)]
    if last:
        p[free] = land(size[free], p[free], rng, near)
    return p


def _flight(last: bool, columns: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(z=-rows["size"]).sort_values(["z", "h", "k1", "k2", "nth"], kind="stable", ignore_index=True)
        seed = [int(rows["h"].iloc[0]) & 0x7FFFFFFFFFFFFFFF, int(rows["h"].iloc[-1]) & 0x7FFFFFFFFFFFFFFF, len(rows)]
        return rows.assign(p=fly(rows["size"].to_numpy(np.float64), rows["p"].to_numpy(), np.random.default_rng(seed), last, NEAR * rows["target"].iloc[0]))[columns]

    return run


def _drawn(docs: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """k1, k2, doc_id, source, size, source_size, target and copies for each row of docs."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD)))
    k1, k2 = row_keys()
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.cast("long").alias("size"), k1.alias("k1"), k2.alias("k2"))
    # repeated rows are told apart by a number, which is the same in every run
    sized = saved(every.groupBy("doc_id", "source", "size", "k1", "k2").agg(F.count("*").alias("rows")), "sizes")
    targets = saved(source_targets(sized, weights, share, cap), "targets")
    count_out = lambda n, size: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / size).cast("long") - 1))
    each = sized.withColumn("block", count_out(F.col("rows"), REPEATS)).withColumn("nth", count_out(F.least(F.lit(REPEATS), F.col("rows") - F.col("block") * REPEATS), 1))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = each.withColumn("nth", F.col("block") * REPEATS + F.col("nth")).join(targets, each["source"].eqNullSafe(targets["source"])).select(
        "k1", "k2", F.col("doc_id").isNotNull().alias("named"), each["source"], "size", "source_size", "target", F.floor(ratio).cast("long").alias("whole"), (ratio - F.floor(ratio)).alias("p"),
        F.xxhash64("k1", "k2", "nth").alias("h"), "nth", F.ceil(F.col("n_rows") / BLOCK).alias("blocks"),
    )
    schema = "k1 bigint, k2 bigint, named boolean, source string, size bigint, source_size bigint, target double, whole bigint, p double, h bigint, nth bigint, blocks bigint"
    columns = [c.split()[0] for c in schema.split(", ")]
    most = targets.agg(F.max(F.ceil(F.col("n_rows") / BLOCK))).first()[0] or 1
    done, todo, level = None, rows, 0
    while True:
        last = most <= 1
        todo = todo.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")))
        flown = todo.groupBy("source", "block").applyInPandas(_flight(last, columns), schema)
        flown = saved(flown, "flight")
        decided = flown.where("p = 0 or p = 1")
        done = decided if done is None else done.unionByName(decided)
        if last:
            break
        # a block leaves two rows at most
        todo = flown.where("p > 0 and p < 1").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("blocks") * 2 / BLOCK)))
        most, level = max(1, -(-most * 2 // BLOCK)), level + 1
    return done.withColumns({"copies": (F.col("whole") + F.col("p")).cast("long"), "doc_id": F.when(F.col("named"), F.col("k1"))})


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each row of docs(doc_id, text, source)."""
    return _drawn(docs, weights, share, cap).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them.

    Of rows that agree in doc_id, text and source, one stands for all, as often as they are taken together.
    """
    a, b, c, n = unused(docs, "_k1", "_k2", "_k3", "_n")
    k1, k2 = row_keys()
    source = lambda s: F.xxhash64(s.isNull(), s)
    copies = _drawn(docs, weights, share, cap).groupBy(F.col("k1").alias(a), F.col("k2").alias(b), source(F.col("source")).alias(c)).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    rows = docs.withColumns({a: k1, b: k2, c: source(F.col("source").cast("string"))}).dropDuplicates([a, b, c]).join(copies, [a, b, c])
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")

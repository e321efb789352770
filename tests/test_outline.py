"""Outline operators against plain-Python walks, for random level sequences and any split into parts."""

from __future__ import annotations

import random

import pytest

from stemma.operators import outline


def up(levels, i):
    way, level = [], levels[i]
    for j in range(i - 1, -1, -1):
        if level <= 0:
            break
        if levels[j] < level:
            if levels[j] <= 0:
                break
            way.append(j)
            level = levels[j]
    return way[::-1]


def end(levels, i):
    return next((j for j in range(i + 1, len(levels)) if max(0, levels[j]) <= max(0, levels[i])), len(levels))


def frame(spark, levels, cuts):
    return spark.createDataFrame([(i, sum(i >= c for c in cuts), v, "x") for i, v in enumerate(levels)], "pos bigint, part int, level int, english string")


CASES = [([3, 2, 2, 1, 3, 3, 0, 2, 4, 1], [2, 7]), ([5], []), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5])]
_r = random.Random(3)
CASES += [([_r.choice([0, 1, 1, 2, 3, 4, 6]) for _ in range(60)], sorted(_r.sample(range(1, 60), k))) for k in (0, 3, 20)]


@pytest.mark.parametrize("levels, cuts", CASES)
def test_against_walks(spark, levels, cuts):
    df = frame(spark, levels, cuts)
    got = {r["pos"]: r["ancestors"] for r in outline.with_ancestors(df, "part").collect()}
    assert got == {i: up(levels, i) for i in range(len(levels))}
    got = {r["pos"]: r["has_children"] for r in outline.has_children(df, "part").collect()}
    assert got == {i: i + 1 < len(levels) and levels[i + 1] > levels[i] for i in range(len(levels))}
    got = {r["pos"]: (r["ord"], r["end_ord"]) for r in outline.with_subtree_end(df, "part").collect()}
    assert got == {i: (i + 1, end(levels, i) + 1) for i in range(len(levels))}
    nodes = spark.createDataFrame([(i,) for i in range(0, len(levels), 2)], "node bigint")
    got = {(r["node"], r["pos"]) for r in outline.subtree_rows(df, nodes, "part").collect()}
    assert got == {(i, j) for i in range(0, len(levels), 2) for j in range(i + 1, end(levels, i))}


def test_parent_takes_level_zero_and_groups_apart(spark):
    df = spark.createDataFrame([("a", 1, 0, 0), ("a", 2, 0, 2), ("b", 1, 0, 1), ("b", 2, 0, 3), ("b", 3, 1, -2), ("b", 4, 1, 1)], "g string, pos bigint, part int, level int")
    got = {(r["g"], r["pos"]): r["parent_pos"] for r in outline.with_parent(df, "part", ("g",)).collect()}
    assert got == {("a", 1): None, ("a", 2): 1, ("b", 1): None, ("b", 2): 1, ("b", 3): None, ("b", 4): 3}


def test_empty(spark):
    df = spark.createDataFrame([], "pos bigint, part int, level int, english string")
    assert outline.with_ancestors(df, "part").collect() == [] and outline.with_subtree_end(df, "part").collect() == []


def shuffled(spark, rows, schema):
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), schema).repartition(5)


@pytest.mark.parametrize("bits", [1, 2])
def test_groups_of_parts_carry_like_one_run(spark, monkeypatch, bits):
    """Few parts in a group of parts, so that parents and ends lie in other parts, other groups, and beyond."""
    monkeypatch.setattr(outline, "FAN_BITS", bits)
    r = random.Random(bits)
    levels = [r.choice([0, 1, 2, 2, 3, 5, 8, 9]) for _ in range(300)]
    cuts = sorted(r.sample(range(1, 300), 60))
    rows = [(g, i, sum(i >= c for c in cuts), v) for g in ("a", None) for i, v in enumerate(levels)]
    df = shuffled(spark, rows, "g string, pos bigint, part int, level int")
    ways = {(x["g"], x["pos"]): x["ancestors"] for x in outline.with_ancestors(df, "part", ("g",)).collect()}
    ends = {(x["g"], x["pos"]): (x["ord"], x["n_rows"], x["end_ord"]) for x in outline.with_subtree_end(df, "part", ("g",)).collect()}
    parents = {(x["g"], x["pos"]): x["parent_pos"] for x in outline.with_parent(df, "part", ("g",)).collect()}
    kids = {(x["g"], x["pos"]): x["has_children"] for x in outline.has_children(df, "part", ("g",)).collect()}
    assert len(ways) == len(ends) == len(parents) == len(kids) == 600
    for g in ("a", None):
        for i in range(300):
            assert ways[g, i] == up(levels, i) and ends[g, i] == (i + 1, 300, end(levels, i) + 1)
            assert parents[g, i] == max((j for j in range(i) if levels[j] < levels[i]), default=None)
            assert kids[g, i] == (i < 299 and levels[i + 1] > levels[i])


def test_ten_thousand_levels_in_a_thousand_parts(spark):
    """A way down and up again, twice: levels are not counted anywhere."""
    deep = 10_000
    levels = [*range(deep), *range(deep - 1, 0, -3), *range(5, deep, 2)]
    df = shuffled(spark, [(i, i // 23, v) for i, v in enumerate(levels)], "pos bigint, part int, level int")
    parents = {x["pos"]: x["parent_pos"] for x in outline.with_parent(df, "part").collect()}
    ends = {x["pos"]: x["end_ord"] for x in outline.with_subtree_end(df, "part").collect()}
    stack, above, after = [], {}, {}
    for i, v in enumerate(levels):
        while stack and levels[stack[-1]] >= v:
            after[stack.pop()] = i + 1
        above[i] = stack[-1] if stack else None
        stack.append(i)
    after |= dict.fromkeys(stack, len(levels) + 1)
    assert parents == above and ends == after


def test_a_part_of_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(9)
        levels = [r.randrange(6) for _ in range(200)]
        df = shuffled(spark, [(i, i // 90, v) for i, v in enumerate(levels)], "pos bigint, part int, level int")
        assert {x["pos"]: x["ancestors"] for x in outline.with_ancestors(df, "part").collect()} == {i: up(levels, i) for i in range(200)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranks_of_names(spark):
    names = [f"f{i * 7919 % 1000:04d}" for i in range(500)]
    got = {x["name"]: x["rank"] for x in outline.ranked(spark.createDataFrame([(n,) for n in names * 2], "name string"), "name").collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names))}

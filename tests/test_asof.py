"""As-of join against a plain search."""

from __future__ import annotations

import random

import pytest

from stemma.operators.asof import last_before


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_last_boundary_at_or_before(spark, kind):
    r = random.Random(len(kind))
    made = {"bigint": lambda x: x, "string": lambda x: f"k{x:05d}", "double": float}[kind]
    # half of all rows have one key; one book has no boundary, another only late ones
    keys = [(b, r.choice([500, r.randrange(1000)])) for b in (1, 2, 3, None) for _ in range(80)]
    marks = [(b, r.randrange(*span), i) for b, span in ((1, (0, 1000)), (3, (900, 1000)), (None, (0, 50))) for i in range(25)]
    rows = spark.createDataFrame([(b, made(k)) for b, k in keys] + [(1, None)], f"book int, key {kind}")
    bounds = spark.createDataFrame([(b, made(k), v) for b, k, v in marks] + [(1, None, 7)], f"book int, key {kind}, at int")
    got = {(x["book"], x["key"]): x["at"] for x in last_before(rows, bounds, "key", "at", ("book",)).collect()}
    want = {}
    for b, k in set(keys):
        before = [(-m, v) for c, m, v in marks if c == b and m <= k]
        if before:
            want[b, made(k)] = min(before)[1]
    assert got == want and 50 < len(want) < len(set(keys))
    alone = {x["key"]: x["at"] for x in last_before(rows.drop("book"), bounds.drop("book"), "key", "at").collect()}
    assert alone == {made(k): min((-m, v) for _, m, v in marks if m <= k)[1] for _, k in keys if any(m <= k for _, m, _ in marks)}

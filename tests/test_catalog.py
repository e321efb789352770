"""Every registered query of the index library against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import pytest

from stemma import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    expected = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in expected.fetchall()]
    assert sorted(map(repr, plain_each(got))) == sorted(map(repr, plain_each(want)))


def plain_each(rows):
    return [tuple(int(v) if isinstance(v, (bool, float)) and float(v).is_integer() else v for v in r) for r in rows]

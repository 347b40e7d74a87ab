"""Every registered query of the bond engine against its SQL in another engine, on a small scale factor."""

import math
import os

import duckdb
import pytest

from cutweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else round(value, 9) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, engine, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        assert got
        return
    result = engine.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in result.fetchall()), key=str)
    assert got == want


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert {len(r.edges.split(",")) for r in entry.entry(spark).collect()} <= {1, 2, 3}

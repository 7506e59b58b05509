"""Every registered query of the engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from tallymill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    rows = sorted(repr(tuple(r[c] for c in order)) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())

"""Each query with SQL against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from cairn.plans import code, service  # noqa: F401 - add to the queries
from cairn.plans.bindings import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    assert got
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == columns
        assert got == sorted(([plain(row[names.index(c)]) for c in columns] for row in r.fetchall()), key=str)

"""Every query of the catalogue against DuckDB on the smallest tables, or for a stable result where SQL can't say it."""

import math
import os

import duckdb
import pytest

from stratavox.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, "nan" if isinstance(v, float) and math.isnan(v) else v) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    expected = duck.execute(ORACLE_SQL[name])
    places = [[x[0] for x in expected.description].index(c) for c in columns]
    assert ordered([r[c] for c in columns] for r in found.collect()) == ordered([r[k] for k in places] for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0

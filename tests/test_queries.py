"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from subsumer.queries import ORACLE_SQL, QUERIES, SCHEMA

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in SCHEMA:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    def cell(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("scan_events", "nary_exact_2", "violations_unaware", "layer_summary")])
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    want = db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.select(*want.columns).collect()) == plain(want.fetchall())


def test_entry_rows(spark):
    assert QUERIES["unary_exact"](spark, str(DATA)).count() == 123

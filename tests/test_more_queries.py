"""The queries that test_queries leaves out, against DuckDB."""

import pytest

from subsumer.queries import ORACLE_SQL, QUERIES

from .test_queries import DATA, db, plain, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", ["scan_events", "nary_exact_2", "violations_unaware", "layer_summary"])
def test_query(spark, db, name):  # noqa: F811
    df = QUERIES[name](spark, str(DATA))
    want = db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.select(*want.columns).collect()) == plain(want.fetchall())

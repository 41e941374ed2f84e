"""Every registered query of the document operators against its SQL, on the smallest data."""

import duckdb
import pytest

import __spark_entry__
from folioforge.plans import records, registry  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def key(row):
    return tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, db, name):
    want = db.sql(registry.SQL[name])
    columns = sorted(want.columns)
    got = registry.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == columns
    rows = sorted(key(r) for r in got.select(columns).collect())
    assert rows == sorted(key(r) for r in want.select(*columns).fetchall()) and rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

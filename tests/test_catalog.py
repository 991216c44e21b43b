"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from foliary.plans import archives, catalog, contents, domain, index, records, reports, stores, streams  # noqa: F401  the others add their queries to the catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 4) if isinstance(v, float) and not math.isnan(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, db, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = db.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]}) q").fetchall()
    assert got, "a query without rows shows nothing"
    assert plain(map(tuple, found.select(columns).collect())) == plain(got)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every registered query of the core against its SQL, at the smallest scale."""

import os

import pytest

from quern import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_agrees(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    oracle.execute(catalogue.ORACLE_SQL[name])
    columns = [x[0] for x in oracle.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, oracle.fetchall()))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())

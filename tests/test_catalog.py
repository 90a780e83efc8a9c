"""Every query of the catalog against its SQL oracle, and the table-free operators on small fixtures."""

import glob
import os
import tempfile

import duckdb
import pytest

from quarryline.plans import catalog, drops, further, hosts, payloads, periodic, stores, surfaces, threats, tracking, vendors  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    expected = sorted((tuple(row[i] for i in order) for row in want.fetchall()), key=key)
    found = sorted((tuple(row[c] for c in names) for row in got.collect()), key=key)
    assert found == expected and found

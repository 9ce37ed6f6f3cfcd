import glob
import math
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value as text, numbers to nine digits."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query's rows are those of its SQL."""

    def check(query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
        result = duck.execute(sql)
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
        assert got == want

    return check

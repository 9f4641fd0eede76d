import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-test-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        at = os.path.join(SF, name)
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Fails unless a DataFrame and a SQL query give the same rows, in any order."""

    def check(df, sql):
        names = sorted(df.columns)
        own = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
        result = duck.execute(sql)
        theirs = [d[0] for d in result.description]
        assert sorted(theirs) == names
        at = [theirs.index(n) for n in names]
        assert own == sorted(repr(tuple(r[k] for k in at)) for r in result.fetchall())

    return check

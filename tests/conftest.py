import os
import sys

import pytest

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # before numpy: its threads can block each other beside the JVM's
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir, duck):
    """Compare a query with its SQL, rows as multisets, numbers to six places."""

    def norm(v):
        return f"{v:.6f}".replace("-0.000000", "0.000000") if isinstance(v, float) else str(v)

    def compare(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
        rel = duck.sql(sql)
        assert sorted(rel.columns) == names
        at = [rel.columns.index(c) for c in names]
        expected = sorted(tuple(norm(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in rel.fetchall())
        assert got == expected

    return compare

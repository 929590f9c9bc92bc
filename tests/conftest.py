import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def check(df, sql):
        ours = df.toArrow()
        cursor = duck.execute(sql)
        theirs = [c[0] for c in cursor.description]
        found = cursor.fetchall()
        assert sorted(ours.column_names) == sorted(theirs)
        names = sorted(ours.column_names)
        at = [theirs.index(n) for n in names]
        mine = zip(*[ours.column(n).to_pylist() for n in names], strict=True)
        assert sorted(map(repr, mine)) == sorted(repr(tuple(r[i] for i in at)) for r in found)

    return check

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.local.dir", f"{folder}/local")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_rows():
    """Holds a query against its SQL on the same tables."""
    import duckdb
    import pandas as pd

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def value(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(value(x) for x in v)
        if v is None or pd.isna(v):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    def rows(frame, columns):
        return sorted((tuple(value(v) for v in r) for r in frame[columns].astype(object).values.tolist()), key=repr)

    def check(df, sql, folder=DATA):
        con = duckdb.connect()
        for n in names:
            con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
        mine, other = df.toPandas(), con.sql(sql).df()
        assert sorted(mine.columns) == sorted(other.columns)
        columns = sorted(mine.columns)
        assert rows(mine, columns) == rows(other, columns)

    return check

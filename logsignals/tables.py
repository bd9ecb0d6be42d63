"""Reading tables, and writing intermediate ones to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one task of an exchange that is sized by its input (sorted and counted, some 100 MB).
ROWS_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def enough_parts(df: DataFrame, rows: int | None = None) -> int:
    """Parts for an exchange of df: those of the session, or one for each `rows` (ROWS_A_TASK) rows where that is more, so that what a task holds doesn't grow with the input."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or ROWS_A_TASK)))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one if all runs in this process, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logsignals-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def saved(df: DataFrame) -> DataFrame:
    """The rows of df written to a table of their own in the shared folder and read again: lineage ends there. The table goes when Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended before
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

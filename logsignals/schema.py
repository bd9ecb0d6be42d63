"""The log record."""

from __future__ import annotations

from pyspark.sql import types as T

LOG = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("ip", T.StringType()), T.StructField("method", T.StringType()), T.StructField("endpoint", T.StringType()),
    T.StructField("status", T.IntegerType()), T.StructField("response_size", T.LongType()), T.StructField("latency", T.DoubleType()), T.StructField("user_agent", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("attack_category", T.StringType()), T.StructField("is_attack", T.BooleanType()), T.StructField("tenant_home_country", T.StringType()),
])
COLUMNS = [f.name for f in LOG]

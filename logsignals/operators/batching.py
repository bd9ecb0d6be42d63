"""Count windows: a global rank without one partition for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsignals.tables import enough_parts, saved


def ranked(df: DataFrame, order: list[str], name: str = "n", parts: int | None = None, kept: list[str] | None = None) -> DataFrame:
    """df, or what it has of the columns `kept`, with the rank from 0 of each row in the order of the columns.

    Rows are dealt by range, as many ranges as their number needs, sorted there once, and written with their range and their place in it; each range's count gives the rank at which
    the next starts (a window over one row a range). So both uses see the same ranges, and no later reading sorts again.
    """
    dealt = df.repartitionByRange(parts or enough_parts(df), *order).sortWithinPartitions(*order)
    dealt = saved(dealt.select(*(kept or df.columns), F.monotonically_increasing_id().alias("_at")))  # the range above 33 bits of the place in it
    dealt = dealt.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")  # one row a range


def count_windows(logs: DataFrame, size: int = 500, parts: int | None = None) -> DataFrame:
    """logs with batch_id: each `size` records in the order of time and record id; the last may be short."""
    return ranked(logs, ["ts", "rec_id"], "_rank", parts).withColumn("batch_id", F.floor(F.col("_rank") / size)).drop("_rank")


def tenant_windows(logs: DataFrame, size: int = 500, parts: int | None = None) -> DataFrame:
    """The same for each tenant: the rank in the order of tenants less that of the tenant's first record, so that a large tenant is dealt over many ranges."""
    n = saved(ranked(logs, ["tenant", "ts", "rec_id"], "_rank", parts))
    first = n.groupBy("tenant").agg(F.min("_rank").alias("_first"))
    return n.join(first, n["tenant"].eqNullSafe(first["tenant"])).drop(first["tenant"]).withColumn("batch_id", F.floor((F.col("_rank") - F.col("_first")) / size)).drop("_rank", "_first")

"""Joins over time of two tables: the newest row at or before (J7), and rows within an interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsignals.tables import saved


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, order: str, parts: int | None = None) -> DataFrame:
    """Rows of left with the columns of the newest row of right of their key whose time isn't later (of equal ones the largest `order`); null where there is none.

    Both tables are put together and dealt by ranges of (key, time), so that a key with many rows is cut by time. Within a range the last row of right is a window along time; a key that goes on from
    one range to the next gets the last row of the ranges before from a table of one row a range. Columns of right other than key and time must not be in left.
    """
    parts = parts or max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    taken = [c for c in right.columns if c not in (key, time)]
    none = F.lit(None)
    mine = left.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(1).alias("_side"), none.cast(right.schema[order].dataType).alias("_order"), F.struct(*left.columns).alias("_left"), none.cast(_struct_of(right, taken)).alias("_right"))
    other = right.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(0).alias("_side"), F.col(order).alias("_order"), none.cast(_struct_of(left, left.columns)).alias("_left"), F.struct(*taken).alias("_right"))
    dealt = saved(mine.unionByName(other).repartitionByRange(parts, "_key", "_time", "_side", "_order").withColumn("_part", F.spark_partition_id()))
    along = Window.partitionBy("_part", "_key").orderBy("_time", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.struct("_key", "_time", "_order")
    ends = dealt.groupBy("_part").agg(F.max_by(F.struct("_key", "_right"), F.when(F.col("_side") == 0, newest)).alias("_end"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    handed = F.broadcast(ends.select("_part", F.last("_end", True).over(ahead).alias("_handed")))  # a row a range
    held = dealt.withColumn("_last", F.last("_right", True).over(along)).filter("_side = 1").join(handed, "_part")
    last = F.coalesce("_last", F.when(F.col("_handed._key").eqNullSafe(F.col("_key")), F.col("_handed._right")))
    known = F.col("_key").isNotNull()  # a null key has no rows of right
    return held.select("_left.*", F.when(known, last).alias("_last")).select(*left.columns, *(F.col(f"_last.{c}").alias(c) for c in taken))


def _struct_of(df: DataFrame, columns: list[str]) -> str:
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType.simpleString()


def within(anchors: DataFrame, rows: DataFrame, key: str, before: int, after: int = 0) -> DataFrame:
    """(anchor_id, rec_id, lag) of the rows of an anchor's key from `before` ahead of it to `after` behind it, both included, in microseconds. anchors(anchor_id, key, us), rows(rec_id, key, us).

    Time is cut into buckets as long as the interval, so that an anchor meets the buckets of its interval's ends and what lies between, at most two: an equi-join on key and bucket, in which a
    busy key is dealt out by time.
    """
    length = max(1, before + after)
    first, last = F.floor((F.col("us") - before) / length), F.floor((F.col("us") + after) / length)
    a = anchors.select("anchor_id", key, F.col("us").alias("_at"), F.explode(F.sequence(first, last)).alias("_bucket"))
    r = rows.select("rec_id", key, "us", F.floor(F.col("us") / length).alias("_bucket"))
    lag = F.col("_at") - F.col("us")
    return a.join(r, [key, "_bucket"]).select("anchor_id", "rec_id", lag.alias("lag")).filter(F.col("lag").between(-after, before))

"""History over batches, on tables of one row a batch or key. Frames end at the batch before unless noted.

A tenant may have any number of batches. Its history is cut into blocks of BLOCK batches: a block also holds the last rows of the one before it (as many as its frames reach back),
and what reaches further back (counters, the last stable threshold) is summed up by block, run over the blocks, and joined to each. So a tenant's history has no seams and
no task has more than a block of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logsignals.config import BLOCK, REMEMBERED, WARMUP
from logsignals.functions.stats import ks
from logsignals.operators.features import running_sums
from logsignals.tables import saved

#: metric: thresholds are taken from its distribution.
METRICS = ("dominant_ratio", "top_count", "avg_latency", "max_entropy", "off_hours_ratio", "periodic_ips")
#: Gaps that a pool holds at most, and parts of a tenant's gaps of which each hands on its own pool.
POOL, PARTS = 2000, 32


def running_mean(df: DataFrame, key: str, value: str, name: str = "baseline", size: int = BLOCK) -> DataFrame:
    """Mean of a key's values in earlier batches; null at first. In two levels, so that a key that all batches share is dealt out."""
    before = running_sums(df, [key], "batch_id", {"_had": F.when(F.col(value).isNotNull(), 1).otherwise(0), "_total": F.coalesce(F.col(value), F.lit(0))}, size)
    return before.select(*df.columns, F.try_divide("_total", "_had").alias(name))


def numbered(df: DataFrame, sent: Column | None = None, size: int = BLOCK) -> DataFrame:
    """batch_no, the number of a tenant's batch from 1, and dispatched, how many of them an agent has been sent, this one included. A row a batch."""
    flag = F.lit(1) if sent is None else sent.cast("int")
    before = running_sums(df, ["tenant"], "batch_id", {"batch_no": F.lit(1), "dispatched": F.coalesce(flag, F.lit(0))}, size)
    return before.withColumns({"batch_no": F.col("batch_no") + 1, "dispatched": F.col("dispatched") + F.coalesce(flag, F.lit(0))})


def in_blocks(df: DataFrame, back: int, size: int = BLOCK) -> DataFrame:
    """Numbered batches with their block, and each block's predecessors within `back` rows once more, marked `halo`."""
    if back > size:
        raise ValueError("frames reach back over more than a block")
    own = F.floor((F.col("batch_no") - 1) / size)
    late = (F.col("batch_no") - 1) % size >= size - back
    cut = df.withColumn("block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("halo", F.col("block") != own)
    return cut.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tenant", "block")  # rows are few and frames long, so blocks mustn't be united in one task


def _block(back: int, to: int = 0):
    return Window.partitionBy("tenant", "block").orderBy("batch_no").rowsBetween(-back, to)


def distributions(df: DataFrame, metrics: tuple[str, ...], most: int = REMEMBERED) -> DataFrame:
    """B4 on batches in blocks: mean and population deviation over the last entries, this one included; null under five. A block (BLOCK batches and its halo) is summed up column-wise: a frame of 500 a row, not 500 steps of each."""
    told = [StructField(f"{m}_{what}", DoubleType()) for m in metrics for what in ("mean", "std")]
    return df.groupBy("tenant", "block").applyInArrow(lambda rows: _moments(rows, metrics, most), StructType([*df.schema.fields, *told]))


def _moments(rows: pa.Table, metrics: tuple[str, ...], most: int) -> pa.Table:
    rows = rows.sort_by("batch_no")
    for m in metrics:
        x = rows[m].cast(pa.float64()).to_numpy()
        frames = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(most - 1, np.nan), x)), most)
        count = np.count_nonzero(~np.isnan(frames), axis=1)
        base = np.nan_to_num(x)  # from the row's own value, so that equal entries have no deviation
        away = frames - base[:, None]
        mean = np.nansum(away, axis=1) / np.maximum(count, 1)
        std = np.sqrt(np.nansum((away - mean[:, None]) ** 2, axis=1) / np.maximum(count, 1))
        for what, value in (("mean", base + mean), ("std", std)):
            rows = rows.append_column(f"{m}_{what}", pa.array(value, mask=count < 5))
    return rows


def stable(metrics: list[str]) -> Column:
    """B5 on batches in blocks: ten entries, and the variance of the last five within 5 % of that of the five before (unless that is 0)."""
    ok: Column = F.col("batch_no") >= 10
    for m in metrics:
        old, new = F.var_pop(m).over(Window.partitionBy("tenant", "block").orderBy("batch_no").rowsBetween(-9, -5)), F.var_pop(m).over(_block(4))
        ok = ok & ((old == 0) | (F.abs(new - old) <= 0.05 * old))
    return F.coalesce(ok, F.lit(False))


def distribution(df: DataFrame, metric: str, most: int = REMEMBERED, size: int = BLOCK) -> DataFrame:
    """B4 of one metric of a table of (tenant, batch_id, metric)."""
    return distributions(in_blocks(numbered(df, size=size), most - 1, size), (metric,), most).filter("NOT halo").select(*df.columns, f"{metric}_mean", f"{metric}_std")


def stability(df: DataFrame, metrics: list[str], name: str = "stable", size: int = BLOCK) -> DataFrame:
    """B5 of metrics of a table of (tenant, batch_id, metrics)."""
    return in_blocks(numbered(df, size=size), 9, size).withColumn(name, stable(metrics)).filter("NOT halo").select(*df.columns, name)


def sticky(df: DataFrame, held: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """B8 on a table of batches in blocks, without their halo: {name: (threshold, when it is stable, cold start)} -> the threshold of the last stable batch, the cold-start value before any.

    The last one within a block is a window; the last one of all blocks before it a window over one row a block.
    """
    run = Window.partitionBy("tenant", "block").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("tenant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    known = {n: F.when(ok, value) for n, (value, ok, _) in held.items()}
    blocks = df.groupBy("tenant", "block").agg(*(F.max_by(e, F.when(e.isNotNull(), F.col("batch_no"))).alias(f"_{n}") for n, e in known.items()))
    blocks = blocks.select("tenant", "block", *(F.last(f"_{n}", True).over(ahead).alias(f"_{n}") for n in known))
    inner = df.withColumns({n: F.last(e, True).over(run) for n, e in known.items()})
    return inner.join(blocks, ["tenant", "block"]).select(*df.columns, *(F.coalesce(n, f"_{n}", F.lit(cold)).alias(n) for n, (_, _, cold) in held.items()))


def history(df: DataFrame, sent: Column | None = None, size: int = BLOCK) -> DataFrame:
    """B4, B5, B8 and B9 for batch features: counters, distributions, and thresholds: three of volume, two of temporal, and entropy. Temporal takes a history of five batches as stable."""
    df = in_blocks(numbered(df, sent, size), REMEMBERED - 1, size)
    df = df.withColumns({"stable": stable(["dominant_ratio", "top_count", "avg_latency"]), "entropy_stable": stable(["max_entropy"])})
    df = saved(distributions(df, METRICS).filter("NOT halo").drop("halo"))
    above = lambda m, k: F.col(f"{m}_mean") + k * F.col(f"{m}_std")
    volume, entropy, temporal = F.col("stable"), F.col("entropy_stable"), F.col("off_hours_ratio_mean").isNotNull()
    return sticky(df, {
        "thr_dominant": (F.least(F.lit(0.99), F.greatest(F.lit(0.65), above("dominant_ratio", 2))), volume, 0.90),
        "thr_rate": (F.greatest(F.lit(50.0), above("top_count", 2)), volume, 450.0),
        "thr_latency": (above("avg_latency", 3), volume, 6500.0),
        "thr_off_hours": (F.least(F.lit(0.99), above("off_hours_ratio", 2)), temporal, 0.85),
        "thr_periodic": (F.greatest(F.lit(2.0), F.floor("periodic_ips_mean") + 1.0), temporal, 2.0),
        "thr_entropy": (above("max_entropy", 2), entropy, 2.0),
    }).drop("block")


def transition_baseline(shares: DataFrame, most: int = REMEMBERED) -> DataFrame:
    """Mean share of a pair over its last entries before the batch; null under five. shares(tenant, batch_id, a, b, share).

    A pair's entries are numbered in two levels and cut into blocks with a halo, like batches.
    """
    n = running_sums(shares, ["tenant", "a", "b"], "batch_id", {"_nth": F.lit(1)})
    own, late = F.floor(F.col("_nth") / BLOCK), F.col("_nth") % BLOCK >= BLOCK - most
    cut = n.withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("tenant", "a", "b", "_block").orderBy("batch_id").rowsBetween(-most, -1)
    cut = cut.withColumn("expected", F.when(F.count("share").over(w) >= 5, F.avg("share").over(w)))
    return cut.filter(F.col("_block") == own).select(*shares.columns, "expected")


def segment(batch_no: Column, first: int = WARMUP - 1) -> Column:
    """0 for the warm-up, then 1, 2, 3 ... for stretches of batches of which each doubles the history."""
    past = F.floor((batch_no - 1) / first)
    return F.when(past > 0, F.length(F.bin(past))).otherwise(0).cast("int")


def gap_pools(gaps: DataFrame, most: int = POOL) -> DataFrame:
    """For each segment of a tenant's batches the sample of positive gaps from all before it: (tenant, segment, rec_id, gap_ms).

    A sample is the `most` gaps of the smallest digests of rec_id, so samples of parts unite: the smallest of the union are among the smallest of its parts. Every part of a segment hands on
    at most `most` gaps, and the pool of a segment is drawn from those of the segments before it, of which there are as many as the number of batches has binary digits.
    gaps(tenant, batch_no, rec_id, gap_ms).
    """
    order = ["digest", "rec_id"]
    g = gaps.filter("gap_ms > 0").select("tenant", segment(F.col("batch_no")).alias("from"), "rec_id", "gap_ms", F.md5(F.col("rec_id").cast("string")).alias("digest"))
    smallest = lambda df, *keys: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= most).drop("_rn")
    parts = smallest(g.withColumn("part", F.pmod(F.xxhash64("rec_id"), F.lit(PARTS))), "tenant", "from", "part").drop("part")
    own = saved(smallest(parts, "tenant", "from"))
    last = own.groupBy("tenant").agg(F.max("from").alias("last"))
    handed = own.join(last, "tenant").withColumn("segment", F.explode(F.sequence(F.col("from") + 1, F.col("last") + 1)))
    return smallest(handed, "tenant", "segment").select("tenant", "segment", "rec_id", "gap_ms")


def gap_tests(gaps: DataFrame, least: int = 200) -> DataFrame:
    """D13 from T2: gaps of a batch's clients with six gaps or more (`many`) against the pool of all earlier segments, by batch after the warm-up, where the pool has `least` gaps.

    gaps(tenant, batch_id, batch_no, rec_id, gap_ms, many).
    """
    pool = gap_pools(gaps).groupBy("tenant", "segment", "gap_ms").agg(F.count("*").alias("n"))
    pool = pool.join(pool.groupBy("tenant", "segment").agg(F.sum("n").alias("size")).filter(F.col("size") >= least), ["tenant", "segment"])
    tested = gaps.filter("many").withColumn("segment", segment(F.col("batch_no"))).filter("segment > 0")
    own = tested.groupBy("batch_id", "gap_ms").agg(F.count("*").alias("n"))
    batches = tested.select("tenant", "segment", "batch_id").distinct()
    other = batches.join(pool, ["tenant", "segment"]).select("batch_id", "gap_ms", "n", F.lit(False).alias("own"))  # at most POOL values a batch
    return ks(own.withColumn("own", F.lit(True)).unionByName(other), "batch_id", "gap_ms", "own", "n").select("batch_id", F.round("statistic", 9).alias("ks"), F.col("p").alias("ks_p"))

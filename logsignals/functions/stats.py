"""Statistical tests over a grouped column of values, as table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsignals.operators.batching import ranked
from logsignals.tables import saved


def zscore_last(df: DataFrame, group: str, order: str, value: str, threshold: float = 3.0) -> DataFrame:
    """The last value against the others (sample deviation, 0 as 1e-9); not significant under four values."""
    m = df.withColumn("back", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order))))
    rest = F.when(F.col("back") > 1, F.col(value))
    a = m.groupBy(group).agg(F.count("*").alias("c"), F.max(F.when(F.col("back") == 1, F.col(value))).alias("last"), F.avg(rest).alias("mean"), F.stddev_samp(rest).alias("sd"))
    sd = F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1e-9).otherwise(F.col("sd"))
    z = F.when(F.col("c") >= 4, F.round((F.col("last") - F.col("mean")) / sd, 3))
    return a.select(group, z.alias("z"), F.coalesce(F.abs(z) > threshold, F.lit(False)).alias("significant"))


def ks(df: DataFrame, group: str, value: str, first: str, weight: str | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p; counts (or weights) are summed by value before they are ordered."""
    n = F.col(weight) if weight else F.lit(1)
    c = df.groupBy(group, value).agg(F.sum(F.when(F.col(first), n).otherwise(0)).alias("x"), F.sum(F.when(F.col(first), 0).otherwise(n)).alias("y"))
    own = Window.partitionBy(group)
    run = own.orderBy(value)
    c = c.select(group, F.sum("x").over(run).alias("a"), F.sum("y").over(run).alias("b"), F.sum("x").over(own).alias("na"), F.sum("y").over(own).alias("nb")).filter("na > 0 AND nb > 0")
    d = c.groupBy(group).agg(F.max(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))).alias("statistic"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    root = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    x = (root + 0.12 + 0.11 / root) * F.col("statistic")
    terms = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, 21)), F.lit(0.0))
    p = F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)))
    return d.withColumn("p", p).withColumn("significant", F.col("p") < 0.05).drop("na", "nb")


def mann_whitney(df: DataFrame, group: str, value: str, first: str) -> DataFrame:
    """U of the first sample by mid-ranks, and z with tie and continuity corrections."""
    c = df.groupBy(group, value).agg(F.count("*").alias("n"), F.sum(F.col(first).cast("int")).alias("x"))
    own = Window.partitionBy(group)
    below = F.coalesce(F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.select(group, "n", "x", (below + (F.col("n") + 1) / 2).alias("rank"))
    a = r.groupBy(group).agg(F.sum(F.col("x") * F.col("rank")).alias("ranks"), F.sum("x").alias("n1"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double").alias("ties")).filter("n1 > 0 AND n1 < n")
    a = a.withColumn("n2", F.col("n") - F.col("n1")).withColumn("u", F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2)
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1))))
    mean = F.col("n1") * F.col("n2") / 2
    return a.select(group, F.col("u"), F.try_divide(F.greatest(F.abs(F.col("u") - mean) - 0.5, F.lit(0.0)), sd).alias("z"))


#: Groups of a block of `set_similarity`, and members met that are counted at once.
GROUPS, MET = 4096, 1 << 22


def set_similarity(df: DataFrame, group: str, member: str, percent: int = 30, most: int = GROUPS) -> DataFrame:
    """T5: Jaccard similarity, to four places, of all pairs of groups with at least `percent` hundredths.

    Groups are dealt into blocks of `most` at most, in their order; a block is one row: its members, and by member the groups that have it. Every block meets every other in a task of its own, which counts
    what each pair shares (`_shared`). So no pair is shuffled, and what is shuffled is the memberships once for each block.
    """
    e = saved(df.select(F.col(group).alias("g"), F.col(member).alias("m")).filter("g IS NOT NULL AND m IS NOT NULL").distinct())
    groups = saved(ranked(saved(e.groupBy("g").agg(F.count("*").alias("n"))), ["g"], "_g"))
    members = saved(ranked(saved(e.groupBy("m").agg(F.count("*").alias("df")).filter("df > 1").select("m")), ["m"], "_m"))
    total = groups.count()
    size = max(1, min(most, -(-total // 8)))
    blocks = max(1, -(-total // size))
    own = e.join(groups, "g").join(members, "m").select(F.floor(F.col("_g") / size).alias("_block"), "_g", "n", "g", "_m")
    kind = e.schema["g"].dataType.simpleString()
    packed = saved(own.groupBy("_block").applyInArrow(_packed, f"_block long, members binary, starts binary, owners binary, sizes binary, names array<{kind}>"))
    half = lambda side, first, last: packed.select(*(F.col(c).alias(f"{side}_{c}") for c in packed.columns if c != "_block"), "_block", F.explode(F.sequence(first, last)).alias("_other"))
    tasks, keys = blocks * (blocks + 1) // 2, ["_block", "_other"]
    one = half("a", F.col("_block"), F.lit(blocks - 1)).repartition(tasks, *keys)
    two = half("b", F.lit(0), F.col("_block")).select(F.col("_other").alias("_block"), F.col("_block").alias("_other"), *(f"b_{c}" for c in packed.columns if c != "_block")).repartition(tasks, *keys)
    counted = one.join(two, keys).mapInArrow(lambda batches: _shared(batches, percent), f"a {kind}, b {kind}, i long, s long")
    return counted.select("a", "b", F.round(F.col("i") / (F.col("s") - F.col("i")), 4).alias("similarity"))


def _packed(rows: pa.Table) -> pa.Table:
    """A block of groups as one row."""
    kept, first, owner = np.unique(rows["_g"].to_numpy(), return_index=True, return_inverse=True)
    number = rows["_m"].to_numpy()
    order = np.argsort(number, kind="stable")
    members, starts = np.unique(number[order], return_index=True)
    names = rows["g"].combine_chunks().take(pa.array(first))
    raw = (members.astype(np.int64), np.append(starts, len(order)).astype(np.int64), owner[order].astype(np.uint16 if len(kept) <= 1 << 16 else np.int64), rows["n"].to_numpy()[first].astype(np.int64))
    return pa.table([pa.array(rows["_block"].to_numpy()[:1]), *(pa.array([x.tobytes()], pa.binary()) for x in raw), pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), names)], ["_block", "members", "starts", "owners", "sizes", "names"])


def _shared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, members of both, sum of sizes) of the pairs between two packed blocks that are similar enough; rows of a at a time, so that the counts at hand stay few."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at] for c in batch.schema.names}

            def side(s: str) -> tuple:
                sizes = np.frombuffer(row[f"{s}_sizes"].as_py(), np.int64)
                raw = lambda c, kind: np.frombuffer(row[f"{s}_{c}"].as_py(), kind)
                return raw("members", np.int64), raw("starts", np.int64), raw("owners", np.uint16 if len(sizes) <= 1 << 16 else np.int64).astype(np.int64), sizes, row[f"{s}_names"].values

            (m1, start1, owner1, n1, names1), (m2, start2, owner2, n2, names2) = side("a"), side("b")
            _, i1, i2 = np.intersect1d(m1, m2, assume_unique=True, return_indices=True)
            many = (start1[1:] - start1[:-1])[i1]
            where = _ranges(start1[i1], many)
            owner, met = owner1[where], np.repeat(i2, many)
            order = np.argsort(owner, kind="stable")
            owner, met = owner[order], met[order]
            begin, reach = start2[met], (start2[1:] - start2[:-1])[met]
            passed = np.concatenate(([0], np.cumsum(reach)))
            width, step = len(n2), max(1, (1 << 19) // max(1, len(n2)))
            for low in range(0, len(n1), step):
                high = min(len(n1), low + step)
                i, end = np.searchsorted(owner, [low, high])
                count = np.zeros((high - low) * width, np.int64)
                while i < end:
                    j = min(end, max(i + 1, int(np.searchsorted(passed, passed[i] + MET, "right")) - 1))
                    count += np.bincount(np.repeat((owner[i:j] - low) * width, reach[i:j]) + owner2[_ranges(begin[i:j], reach[i:j])], minlength=len(count))
                    i = j
                count = count.reshape(high - low, width)
                both = n1[low:high, None] + n2[None, :]
                hit = (count > 0) & (count * 100 >= (both - count) * percent)
                if row["_block"] == row["_other"]:
                    hit &= np.arange(low, high)[:, None] < np.arange(width)[None, :]
                x, y = np.nonzero(hit)
                if len(x):
                    yield pa.RecordBatch.from_arrays([names1.take(pa.array(x + low)), names2.take(pa.array(y)), pa.array(count[x, y]), pa.array(both[x, y])], ["a", "b", "i", "s"])


def _ranges(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... many[0] of them, then those from begin[1] on, and so forth."""
    return np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many)


def address_blocks(ranges: DataFrame, bits: int = 32) -> DataFrame:
    """ranges(lo, hi, ...) cut into aligned blocks: (level, prefix, lo, hi, ...), a block holding the numbers n with n >> level = prefix. A range has two blocks of a level at most."""
    unit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def of_level(k):
        first, end = F.floor((F.col("lo") + unit(k) - 1) / unit(k)), F.floor((F.col("hi") + 1) / unit(k))  # whole blocks are those from first to before end
        left, right = F.when((first % 2 == 1) & (first < end), first), F.when((end % 2 == 1) & (end > first), end - 1)
        return F.filter(F.array(F.struct(k.alias("level"), left.alias("prefix")), F.struct(k.alias("level"), right.alias("prefix"))), lambda b: b["prefix"].isNotNull())

    return ranges.withColumn("_block", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), of_level)))).select("*", "_block.level", "_block.prefix").drop("_block")


def range_lookup(df: DataFrame, ranges: DataFrame, value: str, bits: int = 32) -> DataFrame:
    """Rows of df with the columns of the narrowest range that holds their number (of equal ones the first); rows that no range holds are left out.

    Ranges of any width become a few aligned blocks each, and numbers are looked up by their leading bits, once for each width of block that occurs (33 at most): equi-joins whatever the widths.
    """
    told = [c for c in ranges.columns if c not in ("lo", "hi")]
    blocks = saved(address_blocks(ranges, bits))
    levels = [r["level"] for r in blocks.select("level").distinct().collect()]  # 33 at most
    numbers = df.select(F.col(value).alias("_number")).distinct().withColumn("level", F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>")))
    numbers = numbers.withColumn("prefix", F.call_function("shiftright", F.col("_number"), F.col("level")))
    found = numbers.join(blocks, ["level", "prefix"]).groupBy("_number").agg(F.min_by(F.struct(*told), F.struct(F.col("hi") - F.col("lo"), F.col("lo"), *told)).alias("_range"))
    return df.join(found, F.col(value) == F.col("_number")).select(*df.columns, *(F.col(f"_range.{c}").alias(c) for c in told))


def sketched(df: DataFrame, groups: list[str], values: list[str], lg: int = 14) -> DataFrame:
    """A11 and A16 at scale: a HyperLogLog sketch of each column's distinct values by group, of bounded size (2^lg counters), which unite over groups: hll_union_agg, then hll_sketch_estimate."""
    return df.groupBy(*groups).agg(*(F.hll_sketch_agg(c, lg).alias(c) for c in values))

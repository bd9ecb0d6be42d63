"""Features of log records at three grains: batch and client and endpoint, batch and client, batch.

Every function takes batched logs (batch_id, rec_id, sec, ip, endpoint, status, latency ...); ties go to the first seen.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsignals.config import BLOCK, EPHEMERAL, HUMAN_MEAN_MS, SLOW_DOS_PORTS
from logsignals.functions.scalar import BENIGN_SERVICE_PORTS, INJECTION, SUSPECT, injection, numeric_component, port
from logsignals.operators.batch_profile import batch_profile
from logsignals.tables import enough_parts, saved


def _top(value: Column, count: Column, first: Column) -> Column:
    """The value with the most, of equal ones the first seen."""
    return F.max_by(value, F.struct(count, -first))


def by_batch(logs: DataFrame) -> DataFrame:
    """logs dealt by batch, into as many tasks as their number needs: what follows by batch, client or endpoint of a batch needs no other exchange."""
    return logs.repartition(enough_parts(logs), "batch_id")


def with_tenant(batches: DataFrame, logs: DataFrame) -> DataFrame:
    """batches with the tenant whose records each holds."""
    return batches.join(logs.groupBy("batch_id").agg(F.min("tenant").alias("tenant")), "batch_id")


def pairs(logs: DataFrame) -> DataFrame:
    """(batch, ip, endpoint): n, first, latency sum, records at the latency cap."""
    return logs.groupBy("batch_id", "ip", "endpoint").agg(
        F.count("*").alias("n"), F.min("rec_id").alias("first"), F.sum("latency").alias("lat"), F.count(F.when(F.col("latency") >= 9000, 1)).alias("capped")
    )


def volume_profile(logs: DataFrame) -> DataFrame:
    """A1: two-level counts."""
    ips = logs.groupBy("batch_id", "ip").agg(F.count("*").alias("n"), F.min("rec_id").alias("first"), F.sum("latency").alias("lat"))
    out = ips.groupBy("batch_id").agg(
        F.sum("n").alias("total"), F.count("*").alias("unique_ips"), _top(F.col("ip"), F.col("n"), F.col("first")).alias("top_ip"), F.max("n").alias("top_count"), F.sum("lat").alias("lat")
    )
    return out.select("batch_id", "total", "unique_ips", "top_ip", "top_count", (F.col("top_count") / F.col("total")).alias("dominant_ratio"), (F.col("lat") / F.col("total")).alias("avg_latency"))


def top_k(logs: DataFrame, column: str, k: int = 10) -> DataFrame:
    """A2."""
    counts = logs.groupBy("batch_id", column).agg(F.count("*").alias("n"), F.min("rec_id").alias("first"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("n"), "first")).cast("long")).filter(F.col("rn") <= k).select("batch_id", "rn", column, "n")


def saturation(logs: DataFrame) -> DataFrame:
    """A3 and A4: the busiest pair's share of its endpoint, and the same among plain-HTTP ports."""
    p = pairs(logs).withColumn("ep_total", F.sum("n").over(Window.partitionBy("batch_id", "endpoint")))
    slow = port(F.col("endpoint")).isin(*SLOW_DOS_PORTS)
    key = F.struct(F.col("n"), -F.col("first"))
    best = lambda on, name: F.max_by(F.struct("ip", "endpoint", "n", "ep_total", "lat", "capped"), F.when(on, key)).alias(name)
    a = p.groupBy("batch_id").agg(best(F.lit(True), "t"), F.max_by(F.when(slow, F.struct("ip", "endpoint", "n", "ep_total", "lat", "capped")), F.when(slow, key)).alias("s"))
    return a.select(
        "batch_id", F.col("t.ip").alias("pair_ip"), F.col("t.endpoint").alias("pair_endpoint"), F.col("t.n").alias("pair_count"), (F.col("t.n") / F.col("t.ep_total")).alias("saturation"),
        F.coalesce("s.n", F.lit(0)).alias("slow_count"), F.coalesce(F.col("s.n") / F.col("s.ep_total"), F.lit(0.0)).alias("slow_saturation"),
        F.coalesce(F.col("s.lat") / F.col("s.n"), F.lit(0.0)).alias("slow_latency"), F.coalesce(F.col("s.capped") / F.col("s.n"), F.lit(0.0)).alias("slow_cap_ratio"),
    )


def auth_profile(logs: DataFrame) -> DataFrame:
    """A5 with the gates of A6 and A7: per client totals, failures, successes."""
    a = logs.groupBy("batch_id", "ip").agg(F.count("*").alias("total"), F.count(F.when(F.col("status").isin(401, 403), 1)).alias("failures"), F.count(F.when(F.col("status") == 200, 1)).alias("successes"), F.min("rec_id").alias("first"))
    rate, ratio = F.col("successes") / F.col("total"), F.col("failures") / F.col("total")
    return a.withColumns({"stuffing": (F.col("failures") >= 1) & (F.col("total") >= 20) & rate.between(0.01, 0.08), "mostly_failing": (F.col("failures") >= 1) & (ratio >= 0.8) & (F.col("total") >= 5)})


def entropy_profile(logs: DataFrame, floor: int = 5) -> DataFrame:
    """Bits over the endpoints of each client, ephemeral ports left out."""
    kept = logs.filter(F.coalesce(port(F.col("endpoint")) < EPHEMERAL, F.lit(True)))
    c = kept.groupBy("batch_id", "ip", "endpoint").agg(F.count("*").alias("n"), F.min("rec_id").alias("first"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("batch_id", "ip"))
    e = c.withColumn("p", p).groupBy("batch_id", "ip").agg(F.sum("n").alias("requests"), F.round(-F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"), F.count("*").alias("n_distinct"), F.min("first").alias("first"))
    return e.filter(F.col("requests") >= floor).withColumn("entropy", F.col("entropy") + 0.0)


def max_entropy(logs: DataFrame) -> DataFrame:
    """A9."""
    return entropy_profile(logs).groupBy("batch_id").agg(F.max("entropy").alias("max_entropy"), _top(F.col("ip"), F.col("entropy"), F.col("first")).alias("entropy_ip"), _top(F.col("n_distinct"), F.col("entropy"), F.col("first")).alias("entropy_distinct"))


def injections(logs: DataFrame) -> DataFrame:
    """A10: hits by client and family."""
    hits = logs.select("batch_id", "ip", "rec_id", *(injection(F.col("endpoint"), f).alias(f) for f in INJECTION))
    per = hits.groupBy("batch_id", "ip").agg(F.min("rec_id").alias("first"), *(F.sum(f).alias(f) for f in INJECTION))
    return per.withColumns({"hits": sum((F.col(f) for f in INJECTION), F.lit(0)), "families": sum(((F.col(f) > 0).cast("int") for f in INJECTION), F.lit(0))})


def distinct_endpoints(logs: DataFrame) -> DataFrame:
    """A11."""
    return logs.groupBy("batch_id").agg(F.countDistinct("endpoint").alias("endpoints"))


def port_signature(logs: DataFrame) -> DataFrame:
    """Low service ports and unusual ones in the middle, by client."""
    n = port(F.col("endpoint"))
    unusual = F.coalesce((n >= 1024) & (n < EPHEMERAL) & ~n.isin(*BENIGN_SERVICE_PORTS), n.isNull())
    return logs.groupBy("batch_id", "ip").agg(F.coalesce(F.max((n < 1024).cast("int")), F.lit(0)).alias("low_port"), F.countDistinct(F.when(unusual, F.col("endpoint"))).alias("unusual"), F.count("*").alias("requests"), F.max(F.col("endpoint").startswith("/port_")).alias("any_port"))


def spans(logs: DataFrame) -> DataFrame:
    """Share of records out of hours, and the time span in ms."""
    return logs.groupBy("batch_id").agg(F.avg((F.pmod(F.floor(F.col("sec") / 3600), F.lit(24)) < 6).cast("int")).alias("off_hours_ratio"), ((F.max("sec") - F.min("sec")) * 1000).alias("span_ms"))


def truth(logs: DataFrame) -> DataFrame:
    """Attack share, majority category, dominant attack category."""
    c = logs.groupBy("batch_id", "attack_category").agg(F.count("*").alias("n"), F.min("rec_id").alias("first"))
    attack = F.col("attack_category") != "Benign"
    return c.groupBy("batch_id").agg(
        (F.coalesce(F.sum(F.when(attack, F.col("n"))), F.lit(0)) / F.sum("n")).alias("attack_ratio"), _top(F.col("attack_category"), F.col("n"), F.col("first")).alias("majority"),
        F.max_by(F.when(attack, F.col("attack_category")), F.when(attack, F.struct(F.col("n"), -F.col("first")))).alias("dominant_attack"),
    )


def category_shares(logs: DataFrame) -> DataFrame:
    """Share of each category in its batch."""
    c = logs.groupBy("batch_id", "attack_category").agg(F.count("*").alias("n"))
    return c.select("batch_id", "attack_category", (F.col("n") / F.sum("n").over(Window.partitionBy("batch_id"))).alias("share"))


def triage_observations(logs: DataFrame, bad_ips: tuple[str, ...] = ()) -> DataFrame:
    """A18 with O10: signals of a batch that decide which detectors run."""
    first = logs.withColumn("nth", F.row_number().over(Window.partitionBy("batch_id").orderBy("rec_id"))).filter("nth <= 50")
    head = first.groupBy("batch_id", "ip").agg(F.count("*").alias("n")).groupBy("batch_id").agg((F.max("n") / F.sum("n")).alias("head_share"))
    sums = logs.groupBy("batch_id").agg(
        F.count(F.when(F.col("status").isin(401, 403), 1)).alias("auth_errors"), ((F.max("sec") - F.min("sec")) * 1000).alias("span_ms"), F.countDistinct("endpoint").alias("endpoints"), F.max(F.col("ip").isin(*bad_ips)).alias("known_bad")
    )
    return sums.join(head, "batch_id")


def gaps(logs: DataFrame) -> DataFrame:
    """O1: milliseconds between records of a client."""
    w = Window.partitionBy("batch_id", "ip").orderBy("sec", "rec_id")
    return logs.select("batch_id", "ip", "rec_id", "sec", ((F.col("sec") - F.lag("sec").over(w)) * 1000).alias("gap_ms")).filter("gap_ms IS NOT NULL")


def failure_streaks(logs: DataFrame) -> DataFrame:
    """O2: longest run of failures by client; successes break it, other statuses are skipped."""
    s = by_batch(logs.select("batch_id", "ip", "sec", "rec_id", "status")).filter(F.col("status").isin(200, 401, 403))
    w = Window.partitionBy("batch_id", "ip").orderBy("sec", "rec_id")
    island = F.sum((F.col("status") == 200).cast("int")).over(w)
    runs = s.withColumn("island", island).groupBy("batch_id", "ip", "island").agg(F.count(F.when(F.col("status") != 200, 1)).alias("run"))
    return runs.groupBy("batch_id", "ip").agg(F.max("run").alias("streak"))


def transitions(logs: DataFrame, most: int = 30) -> DataFrame:
    """Endpoint pairs of the clients with the longest sequences."""
    w = Window.partitionBy("batch_id", "ip").orderBy("sec", "rec_id")
    steps = logs.select("batch_id", "ip", "rec_id", F.col("endpoint").alias("a"), F.lead("endpoint").over(w).alias("b"), F.count("*").over(Window.partitionBy("batch_id", "ip")).alias("len"), F.min("rec_id").over(Window.partitionBy("batch_id", "ip")).alias("first"))
    rank = F.dense_rank().over(Window.partitionBy("batch_id").orderBy(F.desc("len"), "first"))
    return steps.withColumn("ip_rank", rank.cast("long")).filter((F.col("ip_rank") <= most) & F.col("b").isNotNull()).select("batch_id", "ip", "ip_rank", "rec_id", "a", "b")


def transition_shares(logs: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent pairs and their shares."""
    c = transitions(logs).groupBy("batch_id", "a", "b").agg(F.count("*").alias("n"), F.min("rec_id").alias("first"))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("batch_id")))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("n"), "first")).cast("long")).filter(F.col("rn") <= k).select("batch_id", "rn", "a", "b", "n", "share")


def sequential_runs(logs: DataFrame, most_step: int = 2) -> DataFrame:
    """Longest run of numbers in endpoints that go on by steps of one or two, by client."""
    n = logs.select("batch_id", "ip", "sec", "rec_id", numeric_component(F.col("endpoint")).alias("v")).filter(F.col("v").between(1, 10000))
    w = Window.partitionBy("batch_id", "ip").orderBy("sec", "rec_id")
    step = F.abs(F.col("v") - F.lag("v").over(w))
    broken = n.withColumn("broken", F.when(step.between(1, most_step), 0).otherwise(1))
    island = broken.withColumn("island", F.sum("broken").over(w))
    return island.groupBy("batch_id", "ip", "island").agg(F.count("*").alias("run")).groupBy("batch_id", "ip").agg(F.max("run").alias("run"))


def cusum(logs: DataFrame, target_ms: float = HUMAN_MEAN_MS, k: float = 0.5) -> DataFrame:
    """Peak of the one-sided cumulative sum for a drop of the gaps, by client of six gaps or more.

    S_t = max(0, S_(t-1) + z_t - k) equals P_t - min(0, least P_s up to t) with P the running sum of z - k.
    """
    g = gaps(logs)
    own = Window.partitionBy("batch_id", "ip")
    z = (F.lit(target_ms) - F.col("gap_ms")) / (F.stddev_pop("gap_ms").over(own) + 1e-6) - k
    run = own.orderBy("sec", "rec_id").rowsBetween(Window.unboundedPreceding, 0)
    p = g.withColumns({"z": z, "count": F.count("*").over(own)}).filter(F.col("count") >= 6).withColumn("p", F.sum("z").over(run))
    return p.withColumn("s", F.col("p") - F.least(F.lit(0.0), F.min("p").over(run))).groupBy("batch_id", "ip").agg(F.max("s").alias("peak"))


def periodicity(logs: DataFrame, floor: int = 10) -> DataFrame:
    """How regular a client's gaps are, and their median."""
    a = gaps(logs).groupBy("batch_id", "ip").agg(F.count("*").alias("gaps"), F.avg("gap_ms").alias("mean"), F.stddev_pop("gap_ms").alias("std"), F.percentile("gap_ms", 0.5).alias("median_gap"), F.min("rec_id").alias("first"))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean"))
    conf = F.when(F.col("std") == 0, 0.99).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv)))
    return a.filter(F.col("gaps") + 1 >= floor).select("batch_id", "ip", "first", "gaps", "median_gap", F.coalesce(conf, F.lit(0.0)).alias("bot_conf"))


def sliding_counts(logs: DataFrame, seconds: int = 60, slices: int = 8) -> DataFrame:
    """Records of a client within the last minute, its start included.

    Time is cut into slices of `slices` windows. A record within a window of its slice's end also stands before the next slice, so that a window over client and slice has
    all it needs, and a client with a large share of all records is dealt out by time.
    """
    window = seconds * 1_000_000
    length = slices * window
    own = F.floor(F.col("us") / length)
    late = F.col("us") >= (own + 1) * length - window
    cut = logs.select("rec_id", "ip", "us", F.col("status").isin(401, 403).cast("int").alias("failed"), own.alias("own"), F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("slice"))
    w = Window.partitionBy("ip", "slice").orderBy("us").rangeBetween(-window, 0)
    counted = cut.select("rec_id", "ip", "own", "slice", F.count("*").over(w).alias("n"), F.sum("failed").over(w).alias("failures"))
    return counted.filter("own = slice").select("rec_id", "ip", "n", "failures")


def impossible_travel(visits: DataFrame, minutes: float = 20) -> DataFrame:
    """O9 by session: changes from one country to another within less than the bound, from (session, country, sec, rec_id)."""
    w = Window.partitionBy("session").orderBy("sec", "rec_id")
    steps = visits.select("session", F.lag("country").over(w).alias("c1"), F.col("country").alias("c2"), (F.col("sec") - F.lag("sec").over(w)).alias("gap"), "sec")
    return steps.filter((F.col("c1") != F.col("c2")) & (F.col("gap") < 60 * minutes))


def log_probability(logs: DataFrame, baseline: DataFrame, least: int = 4) -> DataFrame:
    """Mean log2 of the expected share of each transition of a client (0.01 where nothing is expected), of clients with `least` transitions; baseline(batch_id, a, b, expected)."""
    t = transitions(logs).join(baseline.select("batch_id", "a", "b", "expected"), ["batch_id", "a", "b"], "left")
    each = F.log2(F.greatest(F.coalesce("expected", F.lit(0.01)), F.lit(1e-10)))
    return t.groupBy("batch_id", "ip").agg(F.count("*").alias("transitions"), F.avg(each).alias("log_prob")).filter(F.col("transitions") >= least)


def dominant_period(logs: DataFrame, least: int = 8) -> DataFrame:
    """T4: the period of the largest peak of the gaps' spectrum by client (at most a batch's records), gaps in order of size of time; the gap itself where all are equal."""
    def period(frame: pd.DataFrame) -> pd.DataFrame:
        gap = np.diff(np.sort(frame["sec"].to_numpy(float)) * 1000)
        if gap.std() < 1e-9:
            p = gap[0]
        else:
            p = len(gap) / (1 + int(np.argmax(np.abs(np.fft.rfft(gap))[1:]))) * gap.mean()
        return pd.DataFrame({"batch_id": frame["batch_id"][:1], "ip": frame["ip"][:1], "period_ms": [round(float(p), 2)]})

    enough = logs.select("batch_id", "ip", "sec", F.count("*").over(Window.partitionBy("batch_id", "ip")).alias("n")).filter(F.col("n") >= least)
    return enough.drop("n").groupBy("batch_id", "ip").applyInPandas(period, "batch_id long, ip string, period_ms double")


def endpoint_counts(logs: DataFrame) -> DataFrame:
    """(tenant, batch_id, endpoint, n, first)."""
    return logs.groupBy("tenant", "batch_id", "endpoint").agg(F.count("*").alias("n"), F.min("rec_id").alias("first"))


def rate_spikes(counts: DataFrame, threshold: float = 3.5, busiest: int = 5, kept: int = 10) -> DataFrame:
    """D8 from T1 and B1: mean |z| of the busiest endpoints whose count departs from that of earlier batches of the tenant in which it was among the `kept` (three of them at least; sample deviation). From endpoint_counts.

    The moments of an endpoint's history are running sums in two levels, so an endpoint that all batches share is dealt out by slices of batches. Counts are whole, and so is n * sum of squares - square of
    the sum: the deviation is that of the values.
    """
    rank = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("n"), "first"))
    return departures(saved(counts.withColumn("rn", rank).filter(F.col("rn") <= kept)), threshold, busiest)


def departures(rates: DataFrame, threshold: float = 3.5, busiest: int = 5) -> DataFrame:
    """`rate_spikes` from (tenant, batch_id, endpoint, n, rn) of the endpoints that are remembered."""
    before = running_sums(rates, ["tenant", "endpoint"], "batch_id", {"had": F.lit(1), "total": F.col("n"), "squares": F.col("n") * F.col("n")})
    spread = F.col("had") * F.col("squares") - F.col("total") * F.col("total")
    sd = F.sqrt(spread / (F.col("had") * (F.col("had") - 1)))
    z = F.round((F.col("n") - F.col("total") / F.col("had")) / F.when(spread == 0, 1e-9).otherwise(sd), 3)
    tested = before.filter((F.col("rn") <= busiest) & (F.col("had") >= 3)).withColumn("z", z)
    return tested.filter(F.abs("z") > threshold).groupBy("batch_id").agg(F.avg(F.abs("z")).alias("spike_z"))


def running_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], size: int = BLOCK) -> DataFrame:
    """df with sums of values over the rows of its key before it (0 at first), in two levels: within slices of `size` numbers of `order`, and over the slices."""
    cut = df.withColumns({"_slice": F.floor(F.col(order) / size), **values})
    names = list(values)
    run = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    slices = cut.groupBy(*keys, "_slice").agg(*(F.sum(c).alias(c) for c in names))
    slices = slices.select(*keys, "_slice", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in names))
    inner = cut.withColumns({c: F.coalesce(F.sum(c).over(run), F.lit(0)) for c in names})
    return inner.join(slices, [*keys, "_slice"]).select(*df.columns, *((F.col(c) + F.col(f"_{c}")).alias(c) for c in names))


def entropy_spikes(e: DataFrame) -> DataFrame:
    """D25 from T1: how far the client with the largest entropy stands from the others of its batch (three at least), from A8."""
    w = Window.partitionBy("batch_id")
    e = e.withColumn("rn", F.row_number().over(w.orderBy(F.desc("entropy"), "first")))
    rest = F.when(F.col("rn") > 1, F.col("entropy"))
    a = e.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("entropy").alias("top"), F.avg(rest).alias("mean"), F.coalesce(F.stddev_samp(rest), F.lit(0.0)).alias("sd")).filter("n >= 4")
    return a.select("batch_id", F.round((F.col("top") - F.col("mean")) / F.when(F.col("sd") == 0, 1e-9).otherwise(F.col("sd")), 3).alias("entropy_z"))


def client_profile(dealt: DataFrame) -> DataFrame:
    """A row for each client of a batch with what its records in order of time tell: A1, A5, A13, O1, O2, O6 and O8, from logs dealt by batch.

    Streaks, runs and CUSUM peaks are running values along one sort by client and time, so they need no grouping of their own; one aggregate over (batch, client) follows where the rows lie.
    It holds numbers alone: what needs lists or structs (gaps, medians, busiest pairs) is summed up apart from it.
    """
    keys = ["tenant", "batch_id", "ip"]
    client = Window.partitionBy("batch_id", "ip")
    so_far = client.orderBy("sec", "rec_id").rowsBetween(Window.unboundedPreceding, 0)
    status, number = F.col("status"), numeric_component(F.col("endpoint"))
    failed = status.isin(401, 403)
    read = dealt.select(*keys, "rec_id", "sec", "latency", "status", F.when(number.between(1, 10000), number).alias("v"))
    whole = client.orderBy("sec", "rec_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the one order of all windows here
    before = client.orderBy("sec", "rec_id").rowsBetween(Window.unboundedPreceding, -1)
    steps = read.withColumns({"gap_ms": (F.col("sec") - F.lag("sec").over(client.orderBy("sec", "rec_id"))) * 1000, "fails": F.sum(failed.cast("int")).over(so_far), "nth": F.count("v").over(so_far), "last": F.last("v", True).over(before)})
    gap, begins = F.col("gap_ms"), F.col("v").isNotNull() & ~F.coalesce(F.abs(F.col("v") - F.col("last")).between(1, 2), F.lit(False))
    steps = steps.withColumns({
        "since": F.max(F.when(status == 200, F.col("fails"))).over(so_far), "begun": F.max(F.when(begins, F.col("nth"))).over(so_far), "had": F.count(gap).over(so_far), "passed": F.sum(gap).over(so_far),
        "gaps": F.count(gap).over(whole), "gap_std": F.stddev_pop(gap).over(whole),
    })
    steps = steps.withColumn("p", (F.col("had") * HUMAN_MEAN_MS - F.col("passed")) / (F.col("gap_std") + 1e-6) - 0.5 * F.col("had"))  # sum of (mean - gap) / deviation - 0.5
    steps = steps.withColumn("s", F.when(gap.isNotNull(), F.col("p") - F.least(F.lit(0.0), F.min("p").over(so_far))))
    return steps.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("rec_id").alias("first"), F.sum("latency").alias("lat"), F.count(F.when(failed, 1)).alias("failures"), F.count(F.when(status == 200, 1)).alias("successes"),
        F.count(F.when(F.pmod(F.floor(F.col("sec") / 3600), F.lit(24)) < 6, 1)).alias("off"), F.min("sec").alias("begin"), F.max("sec").alias("end"), F.max(F.col("fails") - F.coalesce("since", F.lit(0))).alias("streak"),
        F.max(F.when(F.col("v").isNotNull(), F.col("nth") - F.col("begun") + 1)).alias("run"), F.max("s").alias("peak"), F.max("gaps").alias("gaps"),
    )


def _pairs_of(dealt: DataFrame) -> DataFrame:
    """`pairs` of logs dealt by batch, with the port of the endpoint: no exchange."""
    return pairs(dealt.select("batch_id", "ip", "endpoint", "rec_id", "latency")).withColumn("place", port(F.col("endpoint")))


def endpoint_profile(dealt: DataFrame) -> DataFrame:
    """A row for each client of a batch with what its endpoints tell: A8, A10 and A12, from logs dealt by batch."""
    place = F.col("place")
    unusual = F.coalesce((place >= 1024) & (place < EPHEMERAL) & ~place.isin(*BENIGN_SERVICE_PORTS), place.isNull())
    served = F.coalesce(place < EPHEMERAL, F.lit(True))
    odd = F.col("endpoint").rlike(SUSPECT)
    c = _pairs_of(dealt).groupBy("batch_id", "ip").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.sum(F.when(served, F.col("n"))).alias("requests"), F.sum(F.when(served, F.col("n") * F.log2("n"))).alias("n_log_n"), F.count(F.when(served, 1)).alias("n_distinct"),
        F.min(F.when(served, F.col("first"))).alias("served_first"), F.coalesce(F.max((place < 1024).cast("int")), F.lit(0)).alias("low_port"), F.count(F.when(unusual, 1)).alias("unusual"), F.max(F.col("endpoint").startswith("/port_")).alias("any_port"),
        *(F.sum(F.when(odd, injection(F.col("endpoint"), f)).otherwise(0) * F.col("n")).alias(f) for f in INJECTION),
    )
    return c.withColumns({
        "entropy": F.when(F.col("requests") >= 5, F.round(F.log2(F.col("requests")) - F.col("n_log_n") / F.col("requests"), 4) + 0.0),
        "hits": sum((F.col(f) for f in INJECTION), F.lit(0)), "families": sum(((F.col(f) > 0).cast("int") for f in INJECTION), F.lit(0)),
    })


def batch_features(logs: DataFrame, bad_ips: tuple[str, ...] = ()) -> DataFrame:
    """One row per batch with what the detectors read, and gap_list (rec_id, gap_ms, many: of a client with six gaps or more)."""
    return features_of(saved(batch_profile(logs, bad_ips)))


def features_of(profile: DataFrame) -> DataFrame:
    """`batch_features` from a written `batch_profile`."""
    part = lambda p, x: F.coalesce(F.col(f"slow_pair.{x}") / F.col(f"slow_pair.{p}"), F.lit(0.0))
    out = profile.select(
        "tenant", "batch_id", "total", "unique_ips", "top_ip", "top_count", (F.col("top_count") / F.col("total")).alias("dominant_ratio"), (F.col("lat") / F.col("total")).alias("avg_latency"),
        F.col("pair.ip").alias("pair_ip"), F.col("pair.endpoint").alias("pair_endpoint"), F.col("pair.n").alias("pair_count"), (F.col("pair.n") / F.col("pair.ep_total")).alias("saturation"),
        F.coalesce("slow_pair.n", F.lit(0)).alias("slow_count"), part("ep_total", "n").alias("slow_saturation"), part("n", "lat").alias("slow_latency"), part("n", "capped").alias("slow_cap_ratio"),
        "top_failures", "failures", "stuffing_ips", "failing_ips", "hits", "families", (F.col("off") / F.col("total")).alias("off_hours_ratio"), ((F.col("end") - F.col("begin")) * 1000).alias("span_ms"), (F.col("top_count") - 1).alias("most_transitions"), "known_bad", "streak",
        "max_entropy", F.col("e.ip").alias("entropy_ip"), F.col("e.n_distinct").alias("entropy_distinct"), ((F.col("e.low_port") == 1) & (F.col("e.unusual") >= 20) & (F.col("e.n") >= 100)).alias("scan_signature"), F.col("e.any_port").alias("any_port"),
        "periodic_ips", "bot_conf", "sequential_ips", "cusum_peak", F.when(F.col("entropies") >= 4, F.round((F.col("max_entropy") - F.col("rest_mean")) / F.when(F.col("rest_std") == 0, 1e-9).otherwise(F.col("rest_std")), 3)).alias("entropy_z"),
        "gap_list", "endpoints", (F.col("attacks") / F.col("total")).alias("attack_ratio"), "majority", "dominant_attack",
    )
    out = out.join(departures(profile.select("tenant", "batch_id", F.inline("rates"))), "batch_id", "left")
    zero = ["streak", "max_entropy", "entropy_distinct", "periodic_ips", "bot_conf", "sequential_ips", "cusum_peak", "spike_z", "entropy_z"]
    return out.fillna(0, zero).fillna(False, ["scan_signature", "any_port"])

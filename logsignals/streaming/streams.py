"""Streams of log records: the batch operators' twins with watermarks, state and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logsignals.operators.fusion import WEIGHTS, RollingWeights

MINUTE_US, ENTRIES = 60_000_000, 500


def window_features(logs: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """ST1: counts by window and client; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    fail = F.col("status").isin(401, 403)
    out = logs.withWatermark("ts", late).groupBy(w.alias("w"), "ip").agg(F.count("*").alias("n"), F.count(F.when(fail, 1)).alias("failures"), F.avg("latency").alias("latency"))
    return out.select(F.col("w.start").alias("start"), "ip", "n", "failures", "latency")


def session_features(logs: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """ST1: sessions by client."""
    out = logs.withWatermark("ts", late).groupBy("ip", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "ip", "n")


class MinuteState(StatefulProcessor):
    """ST2: times of a client's records within the last minute. A timer at the end of that minute drops the state of a client that has gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.times.get()[0]) if self.times.exists() else []
        new = pd.concat(list(rows)).sort_values(["us", "rec_id"])
        out = []
        for rec, us in zip(new["rec_id"], new["us"]):
            held = [t for t in held if t >= us - MINUTE_US] + [int(us)]
            out.append((int(rec), key[0], len(held)))
        self.times.update((held,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer((held[-1] + MINUTE_US) // 1000 + 1)
        yield pd.DataFrame(out, columns=["rec_id", "ip", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"rec_id": pd.Series(dtype="int64"), "ip": pd.Series(dtype="str"), "n": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def minute_counts(logs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST2 as a stream in event time: needs the RocksDB state store."""
    rows = logs.withWatermark("ts", late).select("ip", "rec_id", F.unix_micros("ts").alias("us"), "ts")
    return rows.groupBy("ip").transformWithStateInPandas(MinuteState(), outputStructType="rec_id long, ip string, n long", outputMode="append", timeMode="eventTime")


class RunningBaseline(StatefulProcessor):
    """ST3: what B4, B5 and B8 say of a tenant's windows, from its last ENTRIES values and the threshold that has held since the last stable window."""

    def __init__(self, cold: float, above: float = 2.0) -> None:
        self.cold, self.above = cold, above

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "recent array<double>, n bigint, threshold double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent, n, threshold = self.state.get() if self.state.exists() else ([], 0, self.cold)
        recent, out = list(recent), []
        for start, v in pd.concat(list(rows)).sort_values("start")[["start", "value"]].itertuples(index=False):
            recent, n = (recent + [float(v)])[-ENTRIES:], n + 1
            mean, std = (float(np.mean(recent)), float(np.std(recent))) if len(recent) >= 5 else (None, None)
            stable = n >= 10 and ((old := float(np.var(recent[-10:-5]))) == 0 or abs(float(np.var(recent[-5:])) - old) <= 0.05 * old)
            if stable:
                threshold = mean + self.above * std
            out.append((key[0], start, float(v), mean, std, stable, threshold))
        self.state.update((recent, n, threshold))
        yield pd.DataFrame(out, columns=["tenant", "start", "value", "mean", "std", "stable", "threshold"])

    def close(self) -> None:
        pass


def running_baselines(windows: DataFrame, cold: float, above: float = 2.0) -> DataFrame:
    """ST3 over (tenant, start, value)."""
    schema = "tenant string, start timestamp, value double, mean double, std double, stable boolean, threshold double"
    return windows.groupBy("tenant").transformWithStateInPandas(RunningBaseline(cold, above), outputStructType=schema, outputMode="append", timeMode="none")


class LearnedWeights(StatefulProcessor):
    """ST3, F6: a tenant's verdicts by weights learnt from its verdicts so far; the state is what each agent's last fired findings came to."""

    def __init__(self, last: int, least: int) -> None:
        self.last, self.least = last, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("past", ", ".join(f"{a} array<boolean>" for a in WEIGHTS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = dict(zip(WEIGHTS, self.state.get())) if self.state.exists() else {}
        weights, out = RollingWeights({a: list(p) for a, p in past.items()}, self.last, self.least), []
        for batch, own in pd.concat(list(rows)).sort_values(["batch_id", "agent"]).groupby("batch_id", sort=True):
            fired = own[own["fired"]]
            out.append((key[0], batch, *weights.verdict(list(zip(fired["agent"], fired["score"])))))
        self.state.update(tuple([bool(x) for x in p] for p in weights.past.values()))
        yield pd.DataFrame(out, columns=["tenant", "batch_id", "fused", "is_attack"])

    def close(self) -> None:
        pass


def learned_verdicts(findings: DataFrame, last: int = 100, least: int = 20) -> DataFrame:
    """ST3 over a stream of (tenant, batch_id, agent, score, threat, fired), all findings of a batch in one micro-batch, batches in order: the same verdicts as learned_fusion's, on findings whose conflicts are resolved."""
    return findings.groupBy("tenant").transformWithStateInPandas(LearnedWeights(last, least), outputStructType="tenant string, batch_id long, fused double, is_attack boolean", outputMode="append", timeMode="none")


def alert_sink(path: str, keys: tuple[str, ...] = ("start", "ip")) -> Callable[[DataFrame, int], None]:
    """ST4 for foreachBatch: alerts whose keys an earlier batch has written are left out, and a repeated batch replaces itself, so an alert is written once even if batches are numbered anew.

    Alerts lie by batch and by day of their first key (a time), and of the earlier ones only the days that a batch has are read: what has been written doesn't slow down what comes.
    """
    def write(df: DataFrame, batch: int) -> None:
        new = df.dropDuplicates(list(keys)).withColumn("day", F.floor(F.col(keys[0]).cast("long") / 86_400))
        days = [r["day"] for r in new.select("day").distinct().collect()]  # those within the watermark
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/day=*")
        if at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
            held = df.sparkSession.read.parquet(path).filter(F.col("day").isin(days) & (F.col("batch") != batch)).select(*keys)
            new = new.join(held, list(keys), "left_anti")
        new.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")

    return write


def known_bad(logs: DataFrame, bad: DataFrame) -> DataFrame:
    """ST5: stream and static list."""
    return logs.join(bad.select("ip").distinct(), "ip", "left_semi")


def without_repeats(logs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST6."""
    return logs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["rec_id"])


def replay(spark: SparkSession, path: str, schema, select: Callable[[DataFrame], DataFrame], name: str, mode: str = "append") -> DataFrame:
    """A bounded replay of parquet files through a streaming query; its result as a table in memory (for tests and small runs)."""
    stream = select(spark.readStream.schema(schema).parquet(path))
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)

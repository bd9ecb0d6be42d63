"""A bounded replay gives what the batch operators give."""

import time

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from logsignals.operators import baselines as B
from logsignals.operators import fusion as U
from logsignals.sources import views
from logsignals.streaming import streams


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "logs")
    views.events(spark, DATA).select("rec_id", "ts", "ip", "status", "latency").coalesce(1).sortWithinPartitions("ts").write.parquet(path)
    return path


SCHEMA = "rec_id long, ts timestamp, ip string, status int, latency double"


def test_windows(spark, source):
    got = {(r.start, r.ip): r.n for r in streams.replay(spark, source, SCHEMA, lambda s: streams.window_features(s, "1 hour"), "windows", "complete").collect()}
    batch = spark.read.parquet(source).groupBy(F.window("ts", "1 hour").alias("w"), "ip").count()
    assert got == {(r.w.start, r.ip): r["count"] for r in batch.collect()}


def test_minute_state(spark, source):
    got = {r.rec_id: r.n for r in streams.replay(spark, source, SCHEMA, streams.minute_counts, "minute").collect()}
    times = {}
    for r in spark.read.parquet(source).orderBy("ts", "rec_id").collect():
        times.setdefault(r.ip, []).append((r.ts.timestamp(), r.rec_id))
    want = {rec: sum(t - 60 <= u <= t for u, _ in own[: i + 1]) for own in times.values() for i, (t, rec) in enumerate(own)}
    assert got == want


def test_sessions(spark, source):
    got = {(r.start, r.ip): r.n for r in streams.replay(spark, source, SCHEMA, streams.session_features, "sessions", "complete").collect()}
    batch = spark.read.parquet(source).groupBy("ip", F.session_window("ts", "2 hours").alias("w")).count()
    assert got == {(r.w.start, r.ip): r["count"] for r in batch.collect()}


def test_running_baselines_equal_the_batch_form(spark, tmp_path):
    rows = [(t, i, float((i * 7 + len(t)) % 5 + (i > 12) * 3)) for t in ("a", "bb") for i in range(30)]
    path = str(tmp_path / "windows")
    spark.createDataFrame(rows, "tenant string, batch_id long, value double").select("tenant", F.timestamp_seconds(F.col("batch_id") * 600).alias("start"), "value").coalesce(1).write.parquet(path)
    got = streams.replay(spark, path, "tenant string, start timestamp, value double", lambda s: streams.running_baselines(s, 9.0), "baselines")
    df = spark.createDataFrame(rows, "tenant string, batch_id long, value double")
    cut = B.distributions(B.in_blocks(B.numbered(df), 499), ("value",)).withColumn("stable", B.stable(["value"])).filter("NOT halo")
    want = B.sticky(cut, {"threshold": (F.col("value_mean") + 2 * F.col("value_std"), F.col("stable"), 9.0)})
    key = lambda r, at: (r.tenant, at, r.stable, round(r.threshold, 6), None if r[3] is None else round(r[3], 6), None if r[4] is None else round(r[4], 6))
    assert {key(r, int(r.start.timestamp()) // 600) for r in got.select("tenant", "start", "stable", "mean", "std", "threshold").collect()} == {key(r, r.batch_id) for r in want.select("tenant", "batch_id", "stable", "value_mean", "value_std", "threshold").collect()}


def test_repeats_and_list(spark, source):
    bad = spark.createDataFrame([("10.0.0.1",)], "ip string")
    got = streams.replay(spark, source, SCHEMA, lambda s: streams.known_bad(streams.without_repeats(s.union(s)), bad), "listed").count()
    assert got == spark.read.parquet(source).filter("ip = '10.0.0.1'").count()


def test_alerts_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "start long, ip string")
    write = streams.alert_sink(str(tmp_path))
    write(df, 0)
    write(df, 0)
    write(spark.createDataFrame([(2, "b"), (3, "c")], "start long, ip string"), 1)  # numbered anew after a restart
    assert sorted((r.start, r.ip) for r in spark.read.parquet(str(tmp_path)).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    write(spark.createDataFrame([(200_000, "a"), (1, "a")], "start long, ip string"), 2)
    write(df.limit(0), 3)
    assert sorted((r.start, r.ip, r.day) for r in spark.read.parquet(str(tmp_path)).collect()) == [(1, "a", 0), (2, "b", 0), (3, "c", 0), (200_000, "a", 2)]


def test_learned_verdicts_equal_the_batch_form(spark, tmp_path):
    """Three micro-batches: the state goes on from one to the next."""
    rng, path = np.random.default_rng(1), str(tmp_path / "findings")
    schema = "tenant string, batch_id long, agent string, score double, threat string, fired boolean"
    rows = [("a" if b % 3 else "bb", b, a, float(np.round(0.3 + 0.7 * rng.random(), 3)), "NONE", bool(rng.random() < 0.6)) for b in range(240) for a in U.WEIGHTS]
    for low in (0, 80, 160):
        spark.createDataFrame([r for r in rows if low <= r[1] < low + 80], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their times
    stream = streams.learned_verdicts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), 30, 5)
    query = stream.writeStream.format("memory").queryName("verdicts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {(r.tenant, r.batch_id): (r.fused, r.is_attack) for r in spark.table("verdicts").collect()}
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3
    want = U.learned_fusion(spark.createDataFrame(rows, schema), spark.createDataFrame(sorted({(r[0], r[1]) for r in rows}), "tenant string, batch_id long"), 30, 5)
    assert got == {(r.tenant, r.batch_id): (r.fused, r.is_attack) for r in want.collect()} and len(got) == 240

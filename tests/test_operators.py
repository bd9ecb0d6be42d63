"""Planted records, loops that state the semantics, and properties."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from logsignals.functions import scalar as S
from logsignals.functions import stats as T
from logsignals.operators import batching as W
from logsignals.operators import detectors as D
from logsignals.operators import features as A
from logsignals.operators import fusion as U
from logsignals.sources import adapters, views


NOISE = [(f"10.0.0.{i % 40}", f"/port_{4000 + i * 7}", 200, 1 + i % 5, 50) for i in range(200)]


def logs(spark, records, batch=40):
    """Records (ip, endpoint, status, step in s, latency) of one batch after warm-up."""
    sec, rows = 0, []
    for i, (ip, endpoint, status, step, latency) in enumerate(records):
        sec += step
        rows.append((i, batch, 43200 + sec, ip, endpoint, status, float(latency), "Benign", "t"))
    return spark.createDataFrame(rows, "rec_id long, batch_id long, sec long, ip string, endpoint string, status int, latency double, attack_category string, tenant string")


def context(spark, records, batch=40, countries=()):
    """The batch's features after as many quiet batches; countries: (ip, country) of its clients."""
    own = logs(spark, records, batch)
    quiet = A.batch_features(logs(spark, NOISE, 0)).drop("batch_id").crossJoin(spark.range(batch).withColumnRenamed("id", "batch_id"))
    placed = own.select("batch_id", F.col("ip").alias("key")).join(spark.createDataFrame(list(countries), "key string, country string"), "key", "left")
    return D.with_context(A.batch_features(own).unionByName(quiet), D.geo_features(placed))


def found(spark, records, agent, batch=40, countries=()):
    return D.detect(context(spark, records, batch, countries).filter(f"batch_id = {batch}"), agent).first()


def test_brute_force_fires(spark):
    f = found(spark, NOISE + [("1.2.3.4", "/port_22", 401, 1, 10)] * 15, "auth")
    assert f.fired and f.threat == "BRUTE_FORCE" and f.score == pytest.approx(1.0)


def test_stuffing_fires(spark):
    f = found(spark, [("1.2.3.4", "/port_443", 200 if i % 33 == 0 else 401, 1, 10) for i in range(200)], "auth")
    assert f.fired and f.threat == "CREDENTIAL_STUFFING" and f.score >= 0.7


def test_clean_traffic_is_silent(spark):
    for agent in D.RULES:
        assert not found(spark, NOISE, agent).fired, agent


def test_flood_fires(spark):
    f = found(spark, [("1.2.3.4", "/port_9000", 200, 1 + i % 3, 5) for i in range(480)] + NOISE[:20], "volume")
    assert f.fired and f.threat == "DOS" and f.score >= 0.8


def test_slow_dos_fires(spark):
    f = found(spark, [("1.2.3.4", "/port_80", 200, 1, 10000)] * 150 + NOISE, "volume")
    assert f.fired and f.threat == "DOS"


def test_bots_fire(spark):
    f = found(spark, [x for i in range(30) for x in (("1.1.1.1", "/port_1", 200, 10, 5), ("2.2.2.2", "/port_2", 200, 10, 5))], "temporal")
    assert f.fired and f.threat == "BOT_ACTIVITY"


FLOOD = [("1.2.3.4", "/port_9000", 200, 1 + i % 3, 5) for i in range(480)] + NOISE[:20]
STEPS = NOISE + [("1.1.1.1", f"/port_{100 + i}", 200, 1, 5) for i in range(12)]


def test_warm_up_ends_with_the_fifteenth_and_the_thirtieth_batch(spark):
    assert not found(spark, FLOOD, "volume", 13).fired and found(spark, FLOOD, "volume", 14).fired
    assert not found(spark, STEPS, "sequence", 28).fired and found(spark, STEPS, "sequence", 29).fired
    assert found(spark, FLOOD, "volume", 13).score <= 0.3


def test_one_bot_with_falling_gaps_fires(spark):
    one = NOISE[:60] + [("1.1.1.1", "/port_1", 200, 1, 5)] * 40
    features = context(spark, one).filter("batch_id = 40")
    assert features.first().periodic_ips == 1
    score = lambda peak: D.detect(features.withColumn("cusum_peak", F.lit(peak)), "temporal").first()
    assert not score(3.9).fired and score(4.0).fired and score(4.0).score == pytest.approx(0.72)


def test_ten_failures_without_a_streak_are_brute_force(spark):
    mixed = [x for i in range(12) for x in (("1.2.3.4", "/port_22", 401, 1, 10), ("1.2.3.4", "/port_22", 200 if i % 6 == 5 else 401, 1, 10))]
    f = found(spark, NOISE + mixed, "auth")
    assert f.fired and f.threat == "BRUTE_FORCE" and f.score == pytest.approx(0.84)


def test_countries(spark):
    many = [(f"10.0.0.{i}", f"C{i % 9}") for i in range(40)]
    assert found(spark, NOISE, "geo", countries=many).score == pytest.approx(round(min(0.55 + 0.6 * 9 / 40, 0.8), 2))
    assert found(spark, NOISE, "geo", countries=[("10.0.0.1", "C1")]).score == 0  # too few are known
    assert found(spark, NOISE, "geo", countries=[(f"10.0.0.{i}", "C1") for i in range(40)]).score == pytest.approx(0.8)


def test_travel_between_countries(spark):
    rows = [("s", "A", 0), ("s", "A", 5), ("s", "B", 5 * 60), ("s", "A", 9 * 60), ("t", "A", 0), ("t", "B", 1200), ("u", "A", 0)]
    visits = spark.createDataFrame([(a, b, c, i) for i, (a, b, c) in enumerate(rows)], "session string, country string, sec long, rec_id long")
    assert sorted((r.session, r.c1, r.c2) for r in A.impossible_travel(visits).collect()) == [("s", "A", "B"), ("s", "B", "A")]


def test_period_is_the_peak_of_the_spectrum(spark):
    rng = np.random.default_rng(1)
    steps = [int(x) for x in rng.integers(1, 4, 48) + np.tile([6, 0, 0, 0], 12)]
    got = {r.ip: r.period_ms for r in A.dominant_period(logs(spark, [("a", "/x", 200, s, 1) for s in steps] + [("b", "/y", 200, 1, 1)] * 9)).collect()}
    gap = np.array(steps[1:]) * 1000.0
    peak = max(range(1, len(gap) // 2 + 1), key=lambda k: abs(sum(g * np.exp(-2j * np.pi * k * i / len(gap)) for i, g in enumerate(gap))))
    assert got == {"a": round(len(gap) / peak * gap.mean(), 2), "b": 1000.0}


def test_conflicts_raise_silent_agents_in_fusion(spark):
    rows = [(1, "temporal", 0.9, "BOT_ACTIVITY", True), (1, "volume", 0.3, "NONE", False), (1, "auth", 0.0, "NONE", False), (2, "volume", 0.9, "DOS", True), (2, "temporal", 0.3, "NONE", False)]
    f = spark.createDataFrame(rows, "batch_id long, agent string, score double, threat string, fired boolean")
    got = {(r.batch_id, r.agent): (r.score, r.threat, r.fired) for r in U.resolved(f).collect()}
    assert got[1, "volume"] == (0.405, "DOS", True) and got[1, "auth"] == (0.0, "NONE", False) and got[2, "temporal"] == (0.3, "NONE", False)
    assert {r.batch_id: r.n_agents for r in U.fuse(f).collect()} == {1: 2, 2: 1}


def test_outliers_raise_volume(spark):
    f = spark.createDataFrame([(b, a, 0.1, "NONE", False) for b in range(40) for a in ("volume", "auth")], "batch_id long, agent string, score double, threat string, fired boolean")
    scores = spark.createDataFrame([(b, -0.7 if b == 3 else -0.4, -0.6) for b in range(40)], "batch_id long, iso_score double, cut double")
    got = {(r.batch_id, r.agent): r for r in D.boosted(f, scores).collect()}
    assert len(got) == 80 and got[3, "volume"].fired and got[3, "volume"].threat == "DOS" and got[3, "auth"].score == 0.1 and not got[4, "volume"].fired


def test_similar_sets_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    sets = {g: {f"m{x}" for x in rng.integers(0, 30 if g % 2 else 200, rng.integers(1, 25))} for g in range(60)}
    df = spark.createDataFrame([(g, m) for g, own in sets.items() for m in own], "g long, m string")
    for percent in (10, 30, 80):
        want = {(a, b): round(len(x & y) / len(x | y), 4) for a, x in sets.items() for b, y in sets.items() if a < b and 100 * len(x & y) >= percent * len(x | y)}
        assert {(r.a, r.b): r.similarity for r in T.set_similarity(df, "g", "m", percent).collect()} == pytest.approx(want)


@pytest.mark.parametrize("most", [7, 4096])
def test_crowded_sets_meet_by_blocks_and_no_pair_is_shuffled(spark, most):
    rng = np.random.default_rng(9)
    sets = {f"g{g:03}": {"all"} | {f"m{x}" for x in range(40 * (g % 2))} | {f"m{x}" for x in rng.integers(0, 90, 12)} for g in range(90)}
    df = spark.createDataFrame([(g, m) for g, own in sets.items() for m in own] + [("g000", None), (None, "all"), ("lone", "only")], "g string, m string")
    similar = T.set_similarity(df, "g", "m", 30, most)
    assert "Aggregate" not in similar._jdf.queryExecution().optimizedPlan().toString()  # pairs are counted where blocks meet
    want = sorted((a, b, round(len(x & y) / len(x | y), 4)) for a, x in sets.items() for b, y in sets.items() if a < b and 100 * len(x & y) >= 30 * len(x | y))
    assert len(want) > 900 and sorted((r.a, r.b, r.similarity) for r in similar.collect()) == want


def test_injection_scan_and_sequence_fire(spark):
    assert found(spark, NOISE + [("1.1.1.1", "/s?q=%3Cscript%3E", 200, 1, 5)] * 3, "payload", 5).threat == "WEB_ATTACK"  # injections need no warm-up
    assert found(spark, [("1.1.1.1", f"/port_{20 + 7 * i}", 200, 1, 5) for i in range(400)], "payload").threat == "PORT_SCAN"
    assert found(spark, NOISE + [("1.1.1.1", f"/port_{100 + i}", 200, 1, 5) for i in range(12)], "sequence").fired


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_batches_do_not_depend_on_partitions(spark, parts):
    e = views.events(spark, DATA)
    got = {r.rec_id: r.batch_id for r in W.count_windows(e, 50, parts).collect()}
    order = [r.rec_id for r in e.orderBy("ts", "rec_id").collect()]
    assert got == {r: i // 50 for i, r in enumerate(order)}


def test_cusum_equals_the_loop(spark):
    rng = np.random.default_rng(3)
    steps = rng.integers(1, 9, 40).tolist()
    peak = A.cusum(logs(spark, [("a", "/x", 200, s, 1) for s in steps])).first().peak
    assert peak == pytest.approx(_cusum(steps[1:], 3355.0), abs=1e-6)


def _cusum(steps, target):
    """The peak by a loop."""
    x = np.array(steps) * 1000.0
    s = most = 0.0
    for v in x:
        s = max(0.0, s + (target - v) / (x.std() + 1e-6) - 0.5)
        most = max(most, s)
    return most


def test_cusum_is_held_against_the_mean_of_human_gaps(spark):
    human = [200, 800, 1500, 3000, 500, 12000, 250, 7000, 1100, 4500, 300, 600, 9000, 2200, 800, 350, 18000, 1200, 500, 3300]
    assert sum(human) / len(human) == 3355.0
    steps = [2, 3, 1, 2, 3, 1, 2, 3, 2, 1, 2, 3] * 2
    assert _cusum(steps, 2000.0) < 4 <= _cusum(steps, 3355.0)  # an alarm that the round figure would miss
    own = logs(spark, [("a", "/x", 200, s, 1) for s in [5, *steps]])
    assert A.cusum(own).first().peak == pytest.approx(_cusum(steps, 3355.0), abs=1e-6)
    assert A.batch_features(own).first().cusum_peak == pytest.approx(_cusum(steps, 3355.0), abs=1e-6)


def test_statistics(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([100.0] * 10 + [500.0])], "g string, i int, v double")
    r = T.zscore_last(df, "g", "i", "v").first()
    assert r.significant and r.z > 3
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([100.0, 101.0, 99.0, 100.5, 98.0, 102.0])], "g string, i int, v double")
    assert not T.zscore_last(df, "g", "i", "v").first().significant
    two = spark.createDataFrame([("g", float(i), True) for i in range(50)] + [("g", float(i) + 30, False) for i in range(50)], "g string, v double, f boolean")
    k, m = T.ks(two, "g", "v", "f").first(), T.mann_whitney(two, "g", "v", "f").first()
    assert k.statistic == pytest.approx(0.6) and k.significant
    assert m.u == sum((a > b) + 0.5 * (a == b) for a in range(50) for b in range(30, 80))


def test_scalar_edges(spark):
    rows = [("/port_80abc",), ("/port_0x1f",), ("/api/v1",), ("/a%zz+b",), (None,), ("/port_22/x",)]
    got = {r.e: r for r in spark.createDataFrame(rows, "e string").select("e", S.port(F.col("e")).alias("p"), S.decoded(F.col("e")).alias("d"), S.endpoint_template(F.col("e")).alias("t")).collect()}
    assert got["/port_80abc"].p is None and got["/port_0x1f"].p is None and got["/api/v1"].p is None and got["/port_22/x"].p == 22
    assert got["/a%zz+b"].d == "/a%zz+b" and got["/port_22/x"].t == "/port_22" and got[None].p is None
    ip = spark.createDataFrame([("10.1.2.3",), ("8.8.8.8",), ("bad",), (None,)], "ip string").select(S.is_private(F.col("ip")).alias("p")).collect()
    assert [r.p for r in ip] == [True, False, True, True]


def test_truth_threshold_is_strict_or_not(spark):
    v = spark.createDataFrame([(0, True, "DOS", 0.9, ["volume"])], "batch_id long, is_attack boolean, threat string, confidence double, agents array<string>")
    t = spark.createDataFrame([(0, 25 / 500)], "batch_id long, attack_ratio double")
    assert not U.scores(v, t).first().is_true and U.scores(v, t, inclusive=True).first().is_true


def test_confusion_adds_up(spark):
    df = spark.createDataFrame([(bool(i % 3), bool(i % 2)) for i in range(30)], "is_attack boolean, is_true boolean")
    r = U.confusion(df).first()
    assert r.tp + r.fp + r.fn + r.tn == 30 and 0 <= r.f1 <= 1


def test_empty_logs(spark):
    empty = logs(spark, NOISE[:1]).limit(0)
    geo = D.geo_features(empty.select("batch_id", F.col("ip").alias("key"), F.lit(None).cast("string").alias("country")))
    assert A.batch_features(empty).count() == 0 and D.findings(D.with_context(A.batch_features(empty), geo)).count() == 0


def test_log_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,ip,method,endpoint,status,response_size,latency,user_agent,label,attack_category,is_attack\n2017-07-06T10:00:00Z,1.2.3.4,GET,/port_80,200,5,1.5,,BENIGN,nan,False\nnot a time,1.1.1.1,GET,/x,200,1,1,,DoS,DoS,True\n2017-07-06T10:00:01Z,1.2.3.5,GET,/port_81,x,5,1.5,,DoS Hulk,DoS,False\n")
    df = adapters.read_logs(spark, str(tmp_path / "a.csv"))
    rows = df.orderBy("timestamp").collect()
    assert len(rows) == 2 and rows[0].attack_category == "Benign" and rows[1].is_attack and rows[1].status == 200
    assert adapters.rejected(spark, str(tmp_path / "a.csv")).count() == 1
    adapters.write_logs(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_other_sources(spark, tmp_path):
    line = ",".join(["1.1.1.1", "10", "2.2.2.2", "80", "tcp", "FIN", "0.5", "99", *["0"] * 20, "1421927414", *["0"] * 18, " Backdoors ", "1"])
    (tmp_path / "UNSW-NB15_1.csv").write_text(line + "\n" + line.replace(" Backdoors ,1", ",0") + "\n")
    u = adapters.read_unsw(spark, str(tmp_path / "UNSW*.csv")).orderBy("attack_category").collect()
    assert [r.attack_category for r in u] == ["Backdoor", "Benign"] and u[0].method == "DELETE" and u[0].latency == 500.0 and not u[1].is_attack
    (tmp_path / "flows.csv").write_text(" Timestamp, Source IP, Destination Port, Flow Duration, Total Fwd Packets, Label\n6/7/2017 9:05,1.2.3.4,80,2500000,3,DDoS\nbad,1.2.3.4,80,1,1,BENIGN\n", encoding="latin-1")
    f = adapters.read_flows(spark, str(tmp_path / "flows.csv")).collect()
    (tmp_path / "latin.csv").write_text("Timestamp,Source IP,Destination Port,Flow Duration,Total Fwd Packets,Label\n6/7/2017 9:05,1.2.3.4,80,1,3,Web Attack \u00d7 XSS\n", encoding="latin-1")
    assert adapters.read_flows(spark, str(tmp_path / "latin.csv")).first().label == "Web Attack \u00d7 XSS"
    (tmp_path / "mixed").mkdir()
    line = "Timestamp,Source IP,Destination Port,Flow Duration,Total Fwd Packets,Label\n6/7/2017 9:05,1.2.3.4,80,1,3,Web Attack {} XSS\n"
    (tmp_path / "mixed" / "one.csv").write_text(line.format("\u00d7"), encoding="latin-1")
    (tmp_path / "mixed" / "two.csv").write_text(line.format("\u2013 \u00e9"), encoding="utf-8")
    assert {r.label for r in adapters.read_flows(spark, str(tmp_path / "mixed")).collect()} == {"Web Attack \u00d7 XSS", "Web Attack \u2013 \u00e9 XSS"}  # a file of the one kind doesn't garble those of the other
    verdicts = spark.createDataFrame([(1, True, "DOS")], "batch_id long, is_attack boolean, threat string")
    adapters.write_verdicts(verdicts, verdicts.limit(0), str(tmp_path / "verdicts"))
    assert adapters.read_verdicts(spark, str(tmp_path / "verdicts"), verdicts.schema).collect() == verdicts.collect()
    assert len(f) == 1 and f[0].attack_category == "DDoS" and f[0].latency == 2500.0 and f[0].endpoint == "/port_80"
    (tmp_path / "honey.csv").write_text("datetime,srcstr,proto,dpt\n3/3/13 21:53,61.1.1.1,TCP,1433\n3/3/13 21:53,bad,TCP,1\n")
    h = adapters.read_honeypot(spark, str(tmp_path / "honey.csv")).collect()
    assert len(h) == 1 and h[0].endpoint == "/port_1433" and h[0].is_attack
    (tmp_path / "net.csv").write_text("StartTime,Dur,Proto,SrcAddr,Dport,DstAddr,TotBytes,Label\n2011/08/10 09:46:59.607825,1.0,tcp,147.32.84.1,0x1f,9.9.9.9,66,flow=From-Botnet-V42\n")
    n = adapters.read_netflow(spark, str(tmp_path / "net.csv")).first()
    assert n.ip == "9.9.9.9" and n.endpoint == "/port_unknown" and n.is_attack
    (tmp_path / "http.csv").write_text("kind,Method,User-Agent,URL,content,lenght\nNormal,GET,UA,http://h/a/b?x=1 HTTP/1.1,,\nAnomalous,POST,UA,http://h/c HTTP/1.1,q=1,3\n")
    w = adapters.read_http(spark, str(tmp_path / "http.csv")).orderBy("label").collect()
    assert [r.endpoint for r in w] == ["/a/b", "/c?q=1"]
    (tmp_path / "bad.json").write_text('{"known_bad_ips": ["1.1.1.1", "1.1.1.1", "2.2.2.2"]}')
    assert adapters.read_known_bad(spark, str(tmp_path / "bad.json")).count() == 2


def test_range_lookup_plan_has_no_nested_loop(spark):
    numbers, ranges = spark.range(0, 200000, 97).withColumnRenamed("id", "number"), spark.range(0, 200).select((F.col("id") * 1000).alias("lo"), (F.col("id") * 1000 + 999).alias("hi"), F.col("id").alias("country"))
    out = T.range_lookup(numbers, ranges, "number", 12)
    assert out.count() == numbers.count() and out.filter("country <> number div 1000").isEmpty()
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()

"""History across block edges, models as of their time, and joins over time, against plain loops."""

import collections
import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsignals import tables
from logsignals.functions import stats as T
from logsignals.operators import baselines as B
from logsignals.operators import batching as W
from logsignals.operators import features as A
from logsignals.operators import fusion as U
from logsignals.operators import joins as J
from logsignals.operators import models as M


@pytest.fixture(scope="module")
def batches():
    """1,700 batches of two tenants, ids with gaps; metrics that are quiet for a while now and then, so that they come and go as stable."""
    rng, rows, at, seen = np.random.default_rng(5), [], {"a": 0, "b": 3}, {"a": 0, "b": 0}
    for i in range(1700):
        t = "a" if rng.random() < 0.8 else "b"
        at[t] += int(rng.integers(1, 4))
        seen[t] += 1
        calm = seen[t] // 20 % 2 == 0
        v = lambda scale: float(np.round(scale * (1 + seen[t] % 5 / 100 if calm else 1 + rng.random()), 4))
        rows.append((t, at[t], v(0.3), v(50.0), v(900.0), v(2.5), v(0.2), i % 3, int(rng.integers(0, 6)), False))
    return pd.DataFrame(rows, columns=["tenant", "batch_id", "dominant_ratio", "top_count", "avg_latency", "max_entropy", "off_hours_ratio", "periodic_ips", "endpoints", "known_bad"])


def _plain_history(frame):
    """Batch after batch, with the lists that are remembered."""
    out = {}
    for tenant, own in frame.groupby("tenant"):
        past, thr, sent = collections.defaultdict(list), {"dominant": 0.90, "rate": 450.0, "latency": 6500.0, "off_hours": 0.85, "periodic": 2.0, "entropy": 2.0}, 0
        for n, r in enumerate(own.sort_values("batch_id").itertuples(), 1):
            for m in B.METRICS:
                past[m] = (past[m] + [float(getattr(r, m))])[-500:]
            mean = {m: np.mean(v) if len(v) >= 5 else None for m, v in past.items()}
            std = {m: np.std(v) for m, v in past.items()}

            def stable(*ms):
                for m in ms:
                    if n < 10:
                        return False
                    old, new = np.var(past[m][-10:-5]), np.var(past[m][-5:])
                    if old > 0 and abs(new - old) > 0.05 * old:
                        return False
                return True

            sent += r.endpoints >= 3
            if stable("dominant_ratio", "top_count", "avg_latency"):
                thr |= {"dominant": min(0.99, max(0.65, mean["dominant_ratio"] + 2 * std["dominant_ratio"])), "rate": max(50.0, mean["top_count"] + 2 * std["top_count"]), "latency": mean["avg_latency"] + 3 * std["avg_latency"]}
            if stable("max_entropy"):
                thr["entropy"] = mean["max_entropy"] + 2 * std["max_entropy"]
            if mean["off_hours_ratio"] is not None:
                thr |= {"off_hours": min(0.99, mean["off_hours_ratio"] + 2 * std["off_hours_ratio"]), "periodic": max(2.0, np.floor(mean["periodic_ips"]) + 1)}
            out[tenant, r.batch_id] = (n, sent, *(thr[k] for k in ("dominant", "rate", "latency", "off_hours", "periodic", "entropy")))
    return out


def test_history_has_no_seams_between_blocks(spark, batches):
    names = ("batch_no", "dispatched", "thr_dominant", "thr_rate", "thr_latency", "thr_off_hours", "thr_periodic", "thr_entropy")
    want = _plain_history(batches)
    assert len({v[3] for v in want.values()}) > 20  # thresholds move
    for size in (500, 4096):  # three blocks of one tenant, and one
        got = {(r.tenant, r.batch_id): r for r in B.history(spark.createDataFrame(batches), F.col("endpoints") >= 3, size).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert tuple(r[n] for n in names) == pytest.approx(want[k], abs=1e-9), k
    with pytest.raises(ValueError, match="more than a block"):
        B.history(spark.createDataFrame(batches), None, 100)


def test_distribution_and_stability_across_blocks(spark, batches):
    df = spark.createDataFrame(batches[["tenant", "batch_id", "top_count"]])
    one, many = (B.distribution(df, "top_count", 20, s).orderBy("tenant", "batch_id").toPandas() for s in (5000, 20))
    pd.testing.assert_frame_equal(one, many)
    one, many = (B.stability(df, ["top_count"], size=s).orderBy("tenant", "batch_id").toPandas() for s in (5000, 9))
    pd.testing.assert_frame_equal(one, many)


def test_running_sums_in_slices_of_any_size(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{i % 9}", i, int(rng.integers(0, 50))) for i in range(600)]
    past, want = collections.defaultdict(list), {}
    for k, i, v in rows:
        want[i] = np.mean(past[k]) if past[k] else None
        past[k].append(v)
    df = spark.createDataFrame(rows, "k string, batch_id long, v long")
    for size in (1, 7, 4096):
        assert {r.batch_id: r.baseline for r in B.running_mean(df, "k", "v", size=size).collect()} == pytest.approx(want)


def test_spikes_from_running_moments(spark):
    rng = np.random.default_rng(2)
    counts = [("t", b, e, int(rng.integers(1, 30)) + (400 if (b, e) == (40, "/a") else 0), 10 * b + i) for b in range(50) for i, e in enumerate("/a /b /c".split())] + [("t", b, "/same", 9 if b != 30 else 90, 10 * b + 5) for b in range(50)]
    got = {r.batch_id: r.spike_z for r in A.rate_spikes(spark.createDataFrame(counts, "tenant string, batch_id long, endpoint string, n long, first long")).collect()}
    want = collections.defaultdict(list)
    for _, b, e, n, _ in counts:
        past = [c[3] for c in counts if c[1] < b and c[2] == e]
        if len(past) >= 3:
            sd = np.std(past, ddof=1) or 1e-9
            z = round((n - np.mean(past)) / sd, 3)
            if abs(z) > 3.5:
                want[b].append(abs(z))
    assert {40, 30} <= want.keys() and got == pytest.approx({b: np.mean(z) for b, z in want.items()}, rel=1e-6)


def test_gap_pools_unite(spark):
    import hashlib

    rng = np.random.default_rng(3)
    rows = [("t" if i % 5 else "u", 1 + i // 10, i, float(rng.integers(-3, 50))) for i in range(1500)]
    got = collections.defaultdict(set)
    for r in B.gap_pools(spark.createDataFrame(rows, "tenant string, batch_no long, rec_id long, gap_ms double"), 40).collect():
        got[r.tenant, r.segment].add(r.rec_id)
    segment = lambda n: ((n - 1) // 14).bit_length()
    for tenant in "tu":
        for s in range(1, max(segment(r[1]) for r in rows) + 2):
            known = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for t, n, i, g in rows if t == tenant and g > 0 and segment(n) < s)
            assert got[tenant, s] == {i for _, i in known[:40]}
    assert max(s for _, s in got) == segment(150) + 1


def test_learned_weights_equal_the_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(b, a, float(np.round(rng.random(), 3)), "DOS", bool(rng.random() < 0.5)) for b in range(400) for a in U.WEIGHTS]
    tenants = [("a" if b % 3 else "b", b) for b in range(400)]
    f = spark.createDataFrame(rows, "batch_id long, agent string, score double, threat string, fired boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # the fold goes on over the edges of what Python gets at once
    try:
        got = {r.batch_id: (r.tenant, r.fused, r.is_attack) for r in U.learned_fusion(f, spark.createDataFrame(tenants, "tenant string, batch_id long"), last=30, least=5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    resolved = collections.defaultdict(list)
    for r in U.resolved(f).collect():
        resolved[r.batch_id].append((r.agent, r.score, r.fired))
    past, learnt = {t: {a: [] for a in U.WEIGHTS} for t in "ab"}, 0
    for t, b in tenants:
        total = mass = 0.0
        for a, s, fired in sorted(resolved[b]):
            if fired:
                p = past[t][a]
                w = np.mean(p) if len(p) >= 5 else 1.0
                learnt += w < 1
                w = U.WEIGHTS[a] if w == 1.0 else w
                total, mass = total + w * s, mass + w
        fused = total / mass if mass else 0.0
        attack = bool(mass) and fused >= 0.6
        assert got[b][0] == t and got[b][1] == pytest.approx(fused, abs=6e-4) and got[b][2] == attack
        for a, _, fired in resolved[b]:
            if fired:
                past[t][a] = (past[t][a] + [attack])[-30:]
    assert learnt > 100 and len(got) == 400


def test_learned_weights_start_as_the_fixed_ones(spark):
    f = spark.createDataFrame([(b, a, 0.9, "BRUTE_FORCE", a == "auth") for b in range(5) for a in ("auth", "payload")], "batch_id long, agent string, score double, threat string, fired boolean")
    assert {r.fused for r in U.learned_fusion(f, spark.createDataFrame([("t", b) for b in range(5)], "tenant string, batch_id long")).collect()} == {0.9}


def _numbered(n, odd=(), tenant="t"):
    rng = np.random.default_rng(6)
    return pd.DataFrame({"tenant": tenant, "batch_id": range(n), "batch_no": range(1, n + 1), "x": [50.0 if i in odd else 1 + rng.random() / 10 for i in range(n)], "y": [90.0 if i in odd else 2 + rng.random() / 10 for i in range(n)]})


def test_forests_know_earlier_batches_alone(spark):
    whole = _numbered(160, odd=(77, 120))
    scores = lambda frame: {r.batch_id: (r.iso_score, r.cut) for r in M.isolation(spark.createDataFrame(frame), ["x", "y"], back=60, trees=50).collect()}
    got = scores(whole)
    assert set(got) == set(range(30, 160)) and all(-1 <= s <= 0 for s, _ in got.values())
    assert min(got, key=lambda b: got[b][0]) in (77, 120) and all(got[b][0] <= got[b][1] for b in (77, 120))
    changed = whole.copy()
    changed.loc[100:, ["x", "y"]] *= -7
    later = scores(changed)
    assert all(later[b] == got[b] for b in range(30, 100)) and later[150] != got[150]
    assert {b: s for b, s in scores(whole[:95]).items()} == {b: got[b] for b in range(30, 95)}
    changed = whole.copy()
    changed.loc[:49, ["x", "y"]] += 3  # what is further back than `back` before the version doesn't matter either
    assert all(scores(changed)[b] == got[b] for b in range(110, 160))


def test_isolation_trees_split_as_told():
    x = np.random.default_rng(0).normal(size=(300, 3))
    forest = M.Forest(x, 20, 64, 1)
    for t in range(20):
        at = lambda k: t * forest.nodes + k
        for k in range(forest.nodes):
            if forest.feature[at(k)] >= 0:
                assert k < forest.nodes // 2 and np.isfinite(forest.cut[at(k)])
    far = np.array([[9.0, 9, 9], [0, 0, 0]])
    assert forest.scores(far)[0] < forest.scores(far)[1] and len(forest.scores(far[:0])) == 0
    assert M.Forest(np.ones((40, 2)), 5, 20, 1).scores(np.ones((2, 2))).shape == (2,)  # nothing to split


def test_boosted_trees_learn():
    rng = np.random.default_rng(7)
    x = rng.random((600, 8))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7)).astype(float)
    p = M.boosted_trees(x[:400], y[:400], x[400:])
    assert ((p > 0.5) == (y[400:] == 1)).mean() > 0.9 and ((0 < p) & (p < 1)).all()


def test_stacker_keeps_the_rules_until_it_has_samples(spark):
    rng = np.random.default_rng(8)
    n = 200
    attack = [bool(i % 3 == 0) for i in range(n)]
    f = [(i, a, float(np.round((0.7 if attack[i] else 0.1) + rng.random() / 20, 3)), "DOS", attack[i]) for i in range(n) for a in U.WEIGHTS]
    v = [(i, attack[i], 0.7 if attack[i] else 0.1, "DOS" if attack[i] else "NONE", 0.0) for i in range(n)]
    findings = spark.createDataFrame(f, "batch_id long, agent string, score double, threat string, fired boolean")
    numbers = spark.createDataFrame([("t", i, i + 1) for i in range(n)], "tenant string, batch_id long, batch_no long")
    verdicts = lambda rows: spark.createDataFrame(rows, "batch_id long, is_attack boolean, confidence double, threat string, boost double")
    got = {r.batch_id: r for r in M.stacker(findings, verdicts(v), numbers, tuple(U.WEIGHTS)).collect()}
    assert len(got) == n and all(got[i].p is None and got[i].confidence == v[i][2] for i in range(50)) and all(got[i].p is not None for i in range(50, n))
    assert all((got[i].p > 0.5) == attack[i] and got[i].confidence == pytest.approx(0.4 * v[i][2] + 0.6 * got[i].p, abs=6e-4) for i in range(50, n))
    flipped = [(i, not a, c, t, b) if i >= 120 else (i, a, c, t, b) for i, a, c, t, b in v]
    later = {r.batch_id: r.p for r in M.stacker(findings, verdicts(flipped), numbers, tuple(U.WEIGHTS)).collect()}
    assert all(later[i] == got[i].p for i in range(120))
    rare = [(i, i == 4, 0.5, "DOS", 0.0) for i in range(n)]  # attacks in less than a twentieth
    assert all(r.p is None for r in M.stacker(findings, verdicts(rare), numbers, tuple(U.WEIGHTS)).collect())


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_as_of_join_equals_brute_force(spark, parts):
    rng = np.random.default_rng(9)
    left = [(i, "hot" if i % 2 else str(rng.choice(["a", "b", "none", None])), int(rng.integers(0, 60))) for i in range(300)]
    left = [(i, None if k == "None" else k, t) for i, k, t in left]
    right = [("hot" if i % 3 else str(rng.choice(["a", "b"])), int(rng.integers(5, 60)), i, float(i)) for i in range(60)] + [(None, 1, 99, 9.0)]
    got = {r.id: (r.nth, r.value) for r in J.as_of(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, t long, nth long, value double"), "k", "t", "nth", parts).collect()}
    for i, k, t in left:
        before = [(rt, n, v) for rk, rt, n, v in right if rk == k and k is not None and rt <= t]
        assert got[i] == (max(before)[1:] if before else (None, None))


def test_interval_join_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    rows = [(i, "hot" if i % 2 else f"k{i % 5}", int(rng.integers(-500, 500))) for i in range(300)]
    df = spark.createDataFrame(rows, "rec_id long, ip string, us long")
    for before, after in ((60, 0), (0, 0), (10, 25)):
        got = {(r.anchor_id, r.rec_id, r.lag) for r in J.within(df.filter("rec_id % 3 = 0").withColumnRenamed("rec_id", "anchor_id"), df, "ip", before, after).collect()}
        assert got == {(a, r, t - u) for a, k, t in rows if a % 3 == 0 for r, j, u in rows if j == k and -after <= t - u <= before}


def test_hot_client_is_cut_by_time(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "hot" if i % 2 else f"k{i % 7}", int(rng.integers(0, 900)) * 1_000_000, 401 if i % 4 == 0 else 200) for i in range(500)]
    out = A.sliding_counts(spark.createDataFrame(rows, "rec_id long, ip string, us long, status int"), 60, 2)
    got = {r.rec_id: (r.n, r.failures) for r in out.collect()}
    for i, k, t, _ in rows:
        seen = [s for _, j, u, s in rows if j == k and t - 60_000_000 <= u <= t]
        assert got[i] == (len(seen), sum(s == 401 for s in seen))
    assert len(got) == 500


def test_large_tenants_are_dealt_over_ranges(spark):
    rows = [(i, ["big", "big", "small", None][i % 4], datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=(i * 37) % 101)) for i in range(400)]
    df = spark.createDataFrame(rows, "rec_id long, tenant string, ts timestamp")
    for parts in (1, 7):
        got = {r.rec_id: r.batch_id for r in W.tenant_windows(df, 30, parts).collect()}
        for tenant in ("big", "small", None):
            order = sorted((ts, i) for i, t, ts in rows if t == tenant)
            assert [got[i] for _, i in order] == [n // 30 for n in range(len(order))]


def test_history_of_clients_in_blocks(spark):
    logs = spark.createDataFrame([(b, ip) for b in range(60) for ip in (["hot"] if b % 7 else ["hot", "rare"])], "batch_id long, ip string")
    v = spark.createDataFrame([(b, b % 2 == 0, b / 100) for b in range(60)], "batch_id long, is_attack boolean, confidence double")
    for size in (4, 4096):
        got = {(r.ip, r.batch_id): r.rn for r in U.ip_history(logs, v, 10, size).collect()}
        assert got == {("hot", 59 - i): i + 1 for i in range(10)} | {("rare", 7 * (8 - i)): i + 1 for i in range(9)}


def test_longest_match_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    ranges = [(0, 2**32 - 1, "all"), (10 << 24, (11 << 24) - 1, "/8"), (10 << 24, (10 << 24) + 65535, "/16"), ((10 << 24) + 256, (10 << 24) + 511, "/24"), ((10 << 24) + 300, (10 << 24) + 300, "/32")]
    for i in range(60):
        lo = (10 << 24) + int(rng.integers(0, 3000))
        ranges.append((lo, lo + int(rng.integers(0, 700)), f"r{i:02}"))
    numbers = [*((10 << 24) + int(x) for x in rng.integers(0, 4000, 400)), 0, 5, 2**32 - 1, 11 << 24, (11 << 24) - 1, (10 << 24) + 300]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)] + [(-1, None)], "id long, number long")
    got = {r.id: r.country for r in T.range_lookup(df, spark.createDataFrame(ranges, "lo long, hi long, country string"), "number").collect()}
    assert got == {i: min((hi - lo, lo, c) for lo, hi, c in ranges if lo <= n <= hi)[2] for i, n in enumerate(numbers)}
    blocks = T.address_blocks(spark.createDataFrame(ranges, "lo long, hi long, country string")).collect()
    held = collections.defaultdict(int)
    for b in blocks:
        held[b.country] += 1 << b.level
        assert b.lo <= b.prefix << b.level and ((b.prefix + 1) << b.level) - 1 <= b.hi
    assert all(held[c] == hi - lo + 1 for lo, hi, c in ranges)


def test_sketches_unite(spark):
    rows = spark.range(40_000).select((F.col("id") % 10).alias("g"), F.format_string("v%d", F.col("id") % 9_000).alias("v"))
    about = T.sketched(rows, ["g"], ["v"]).agg(F.hll_sketch_estimate(F.hll_union_agg("v"))).first()[0]
    assert abs(about - 9_000) < 0.03 * 9_000


def test_exchanges_have_as_many_parts_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    values = [(i, (i * 7919) % 2003 if i % 50 else None) for i in range(2003)]
    df = spark.createDataFrame(values, "id long, v long")
    got = W.ranked(df, ["v", "id"], "n")
    assert len({r.p for r in got.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1 and tables.enough_parts(df) == 21
    want = {i: n for n, (i, _) in enumerate(sorted(values, key=lambda x: (x[1] is not None, x[1] or 0, x[0])))}
    assert {r.id: r.n for r in got.collect()} == want
    logs = got.select((F.col("n") % 40).alias("batch_id"), F.lit("a").alias("ip"), F.col("n").alias("sec"), F.col("n").alias("rec_id"), F.lit(401).alias("status"))
    assert A.by_batch(logs).rdd.getNumPartitions() == 21
    assert {r.streak for r in A.failure_streaks(logs).collect()} == {50, 51}


def test_scenarios_say_what_the_expressions_say(spark):
    from logsignals.sources import views as V

    at = spark.range(0, 3 * V.PERIOD * V.WINDOW, 7).withColumns({"b": F.expr("id div 500"), "i": F.expr("id % 500"), "m": F.expr("(id div 500) % 10"), "l_suppkey": F.expr("id % 1013"), "l_partkey": F.expr("id % 20011"), "l_quantity": F.expr("cast(id % 50 as double)")})
    plain = at.withColumns({k: F.expr(e) for k, e in V._FLAGS.items()}).select((F.col("id") % (V.PERIOD * V.WINDOW)).alias("_at"), *(F.expr(e.format(div="div", text="string")).alias(f"want_{c}") for c, e in V._PLANTED.items()))
    both = plain.join(V.scenarios(spark), "_at")
    assert both.count() == at.count()
    for c in ("tenant", "status", "attack_category", "ip", "endpoint", "latency"):
        assert both.filter(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"want_{c}"))).isEmpty(), c
    own = {"ip": "10.0.%", "endpoint": "/port_%"}
    assert all(both.filter(F.col(c).isNull() & ~F.col(f"want_{c}").like(p)).isEmpty() for c, p in own.items())


def test_injections_are_found_where_texts_look_plain(spark):
    ends = ["/etc/passwd", "/WINDOWS/system32/x", "/proc/self/fd", "/a%3Cscript%3E", "/x?onload=1", "/b;ls", "/port_80", "/plain/path_9"]
    rows = [("t", 0, "1.1.1.1", e, n, n, 1.0, 200) for n, e in enumerate(ends)]
    df = spark.createDataFrame(rows, "tenant string, batch_id long, ip string, endpoint string, rec_id long, sec long, latency double, status int")
    assert A.endpoint_profile(A.by_batch(df)).first().hits == A.injections(df).first().hits == 6
    assert not {f.dataType.typeName() for f in A.client_profile(A.by_batch(df.withColumn("tenant", F.lit("t")))).schema} & {"array", "struct"}


def test_one_pass_says_what_windows_and_aggregates_say(spark):
    from logsignals.operators.batch_profile import batch_profile

    rng = np.random.default_rng(3)
    odd = ["/etc/passwd", "/x?onload=1", "/item?id=1%27%20or%201", "/port_80/x", "/port_022", "/port_-5", "/port_+7", "/port_99999999999", "/api/7", "/port_unknown", None, *(f"/port_{n}" for n in (22, 80, 443, 8080, 9100, 49151, 49152))]
    rows = []
    for n in range(3000):
        ip = rng.choice(["a", "b", "c", "d", "e", "f"]) if rng.random() < 0.6 else f"10.0.0.{rng.integers(0, 200)}"
        run = f"/page/{1 + n % 40}" if ip == "b" else str(rng.choice([e for e in odd if e])) if rng.random() < 0.7 else f"/port_{rng.integers(0, 60000)}"
        rows.append((f"t{n // 1500}", n // 500, None if n % 97 == 0 else str(ip), None if n % 89 == 0 else run, n, 2 * n if ip != "c" else n - n % 10, float(rng.integers(0, 100000)) / 10, int(rng.choice([200, 401, 403, 500])), str(rng.choice(["Benign", "DoS", "Botnet"]))))
    df = spark.createDataFrame(rows, "tenant string, batch_id long, ip string, endpoint string, rec_id long, sec long, latency double, status int, attack_category string")
    dealt = A.by_batch(df)
    got = batch_profile(df, ("a",)).toPandas().set_index("batch_id")
    clients, ends = A.client_profile(dealt).toPandas(), A.endpoint_profile(dealt).toPandas()
    counts = A.endpoint_counts(df).toPandas()
    for b, mine in clients.groupby("batch_id"):
        row, told = got.loc[b], ends[ends.batch_id == b]
        assert (row.total, row.unique_ips, row.failures, row.top_failures, row.streak, row.off) == (mine.n.sum(), len(mine), mine.failures.sum(), mine.failures.max(), mine.streak.max(), mine.off.sum())
        assert row.sequential_ips == (mine.run >= 10).sum() and row.lat == pytest.approx(mine.lat.sum()) and row.cusum_peak == pytest.approx(mine[mine.gaps >= 6].peak.max())
        assert row.hits == told.hits.sum() and row.max_entropy == told.entropy.max() and row.entropies == told.entropy.notna().sum() and row.known_bad
        best = told.sort_values(["entropy", "served_first"], ascending=[False, True]).iloc[0]
        assert (row.e["ip"], row.e["n_distinct"], row.e["low_port"], row.e["unusual"], row.e["n"]) == (best.ip, best.n_distinct, best.low_port, best.unusual, best.n)
        others = told[told.entropy.notna() & (told.index != best.name)].entropy
        assert row.rest_mean == pytest.approx(others.mean()) and row.rest_std == pytest.approx(others.std(ddof=1))
        most = counts[counts.batch_id == b].sort_values(["n", "first"], ascending=[False, True]).head(10)
        assert [(x["endpoint"], x["n"]) for x in row.rates] == [(None if e is None or e != e else e, n) for e, n in zip(most.endpoint, most.n)]
        assert sum(x["n"] for x in row.clients) == row.total and len(row.clients) == row.unique_ips
    want = {r.batch_id: (r.attack_ratio, r.majority, r.dominant_attack) for r in A.truth(df).collect()}
    assert {b: (r.attacks / r.total, r.majority, r.dominant_attack) for b, r in got.iterrows()} == want
    pair = {r.batch_id: (r.pair_ip, r.pair_endpoint, r.pair_count, r.saturation, r.slow_count) for r in A.saturation(df).collect()}
    assert {b: (r.pair["ip"], r.pair["endpoint"], r.pair["n"], r.pair["n"] / r.pair["ep_total"], r.slow_pair["n"] if r.slow_pair else 0) for b, r in got.iterrows()} == pair
    logs = spark.range(0, 100).select(F.lit("t").alias("tenant"), F.col("id").alias("batch_id"), *(F.col("id").alias(c) for c in ("rec_id", "sec")), *(F.lit("x").alias(c) for c in ("ip", "endpoint", "attack_category")), F.lit(200).alias("status"), F.lit(1.0).alias("latency"))
    plan = batch_profile(logs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_moments_of_long_frames(spark):
    values = [None if i % 11 == 3 else 0.3 if i < 40 else float(i % 13) for i in range(120)]
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "tenant string, batch_id long, m double")
    got = {r.batch_id: (r.m_mean, r.m_std) for r in B.distribution(df, "m", 20, 32).collect()}
    for i in range(120):
        past = [v for v in values[max(0, i - 19): i + 1] if v is not None]
        assert got[i] == (pytest.approx((np.mean(past), np.std(past)), abs=1e-12) if len(past) >= 5 else (None, None))
    assert got[30] == (0.3, 0.0)  # equal entries have no deviation


def test_history_of_clients_that_stand_once(spark):
    from logsignals.operators import fusion as U

    logs = spark.createDataFrame([(b, ip) for b in range(30) for ip in ("a", "b", None, f"c{b % 7}") for _ in range(2)], "batch_id long, ip string")
    verdicts = spark.createDataFrame([(b, b % 3 == 0, b / 30) for b in range(30)], "batch_id long, is_attack boolean, confidence double")
    rows = lambda df: sorted(map(repr, df.select("batch_id", "ip", "is_attack", "confidence", "rn").collect()))
    want = rows(U.ip_history(logs, verdicts, 5, 8))
    assert rows(U.ip_history(logs.distinct(), verdicts, 5, 8, once=True)) == want
    plan = U.ip_history(logs.distinct(), verdicts, 5, 8, once=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # that of the test's own distinct

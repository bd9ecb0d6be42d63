
from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsignals.config import EPHEMERAL, HUMAN_MEAN_MS, WARMUP
from logsignals.functions import scalar as S
from logsignals.functions import stats as T
from logsignals.operators import batching as W
from logsignals.operators import baselines as B
from logsignals.operators import detectors as D
from logsignals.operators import features as A
from logsignals.operators import fusion as U
from logsignals.operators import joins as J
from logsignals.operators import models as M
from logsignals.plans import detector_sql as Q
from logsignals.sources import views as V
from logsignals.tables import saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BAD = ("203.0.113.4", "203.0.113.9")
KEY = "n * 10000000000 - first"  # most, then first seen
PORT = "try_cast(split_part(list_extract(string_split(endpoint, '/port_'), -1), '/', 1) AS INTEGER)"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql


def on_planted(name: str, f: Callable[..., DataFrame], sql: str | None = None, *ctes: str) -> None:
    """f takes the planted logs and, if it has a second argument, the countries of address ranges."""
    ranges = "r" in f.__code__.co_varnames[: f.__code__.co_argcount]
    add(name, lambda s, d: f(V.planted(s, d), V.country_ranges(s, d)) if ranges else f(V.planted(s, d)), sql, *([V.PLANTED, *ctes] if sql else []))


def bad_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ip,) for ip in BAD], "ip string")


# Batching (W)
add("w1_batches", lambda s, d: W.count_windows(V.events(s, d)).select("rec_id", "batch_id"), "SELECT rec_id, (row_number() OVER (ORDER BY ts, rec_id) - 1) // 500 AS batch_id FROM ev", V.EVENTS)
add("w1_tenant_batches", lambda s, d: W.tenant_windows(V.events(s, d).withColumn("tenant", F.col("ip")), 20).select("rec_id", "batch_id"), "SELECT rec_id, (row_number() OVER (PARTITION BY ip ORDER BY ts, rec_id) - 1) // 20 AS batch_id FROM ev", V.EVENTS)
add("w2_sliding_minute", lambda s, d: A.sliding_counts(V.events(s, d), 86400), "SELECT rec_id, ip, count(*) OVER w AS n, count(*) FILTER (status = 401) OVER w AS failures FROM ev WINDOW w AS (PARTITION BY ip ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)", V.EVENTS)
on_planted("w3_after_warmup", lambda l: l.filter("batch_id >= 10").groupBy("batch_id").agg(F.count("*").alias("n")), "SELECT batch_id, count(*) AS n FROM logs WHERE batch_id >= 10 GROUP BY batch_id")
add("w4_time_windows", lambda s, d: V.events(s, d).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == 401, 1)).alias("failures")).select(F.unix_seconds("w.start").alias("start"), "n", "failures"), "SELECT sec - sec % 3600 AS start, count(*) AS n, count(*) FILTER (status = 401) AS failures FROM ev GROUP BY 1", V.EVENTS)
add("w4_sessions", lambda s, d: V.events(s, d).groupBy("ip", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("ip", F.unix_micros("w.start").alias("start"), "n"),
    "SELECT ip, min(us) AS start, count(*) AS n FROM (SELECT ip, us, sum(new) OVER (PARTITION BY ip ORDER BY us, rec_id) AS k FROM (SELECT ip, us, rec_id, CASE WHEN us - lag(us) OVER (PARTITION BY ip ORDER BY us, rec_id) < 7200000000 THEN 0 ELSE 1 END AS new FROM ev)) GROUP BY ip, k", V.EVENTS)

# Sources and sorts (S)
add(
    "s2_first_rows", lambda s, d: W.ranked(V.events(s, d), ["rec_id"], "nth").filter(F.col("nth") < 1000).select("rec_id", "ip"),
    "SELECT rec_id, ip FROM (SELECT rec_id, ip, row_number() OVER (ORDER BY rec_id) AS nth FROM ev) WHERE nth <= 1000", V.EVENTS,
)
on_planted("s13_top_endpoints", lambda l: l.groupBy("endpoint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "endpoint").limit(15), "SELECT endpoint, count(*) AS n FROM logs GROUP BY endpoint ORDER BY n DESC, endpoint LIMIT 15")
on_planted("s13_rollup", lambda l: l.rollup("attack_category", "status").agg(F.count("*").alias("n")), "SELECT attack_category, status, count(*) AS n FROM logs GROUP BY ROLLUP (attack_category, status)")
add("s4_valid_rows", lambda s, d: table(s, d, "events").select(F.col("event_id").cast("long").alias("rec_id"), F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("value").cast("double").alias("value")).filter("k IS NOT NULL AND value IS NOT NULL"), "SELECT event_id::BIGINT AS rec_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, value::DOUBLE AS value FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL AND value IS NOT NULL")

# Scalar functions (P)
on_planted("p1_endpoint_template", lambda l: l.select("rec_id", S.endpoint_template(F.concat("endpoint", F.lit("/x"))).alias("template")), "SELECT rec_id, coalesce(nullif(regexp_extract(endpoint || '/x', '^(/port_[0-9]+)', 1), ''), endpoint || '/x') AS template FROM logs")
on_planted("p2_session_id", lambda l: l.select("rec_id", S.session_id(F.col("ip"), F.lit(""), F.col("endpoint")).alias("session")), "SELECT rec_id, substr(md5(ip || '||' || endpoint), 1, 10) AS session FROM logs")
on_planted("p3_null_sentinels", lambda l: l.select("rec_id", S.or_default(F.when(F.col("status") == 401, "NaN").otherwise(F.col("ip")), "unknown").alias("value")), "SELECT rec_id, CASE WHEN status = 401 THEN 'unknown' ELSE ip END AS value FROM logs")
on_planted("p4_port", lambda l: l.select("rec_id", S.port(F.col("endpoint")).alias("port")), f"SELECT rec_id, {PORT} AS port FROM logs")
on_planted("p5_latency", lambda l: l.select("rec_id", S.latency_ms(F.col("latency") * 3000).alias("ms")), "SELECT rec_id, greatest(0.0::DOUBLE, least(latency * 3000 / 1000, 10000.0::DOUBLE)) AS ms FROM logs")
_PROTO = "CASE rec_id % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN ' UDP' WHEN 2 THEN 'icmp' ELSE 'sctp' END"
add("p6_method", lambda s, d: V.events(s, d).select("rec_id", S.method(F.expr(_PROTO)).alias("method")), "SELECT rec_id, CASE rec_id % 4 WHEN 1 THEN 'POST' WHEN 2 THEN 'OPTIONS' ELSE 'GET' END AS method FROM ev", V.EVENTS)
_RAW = ("BENIGN", "DDoS", "DoS Hulk", "DoS GoldenEye", "DoS slowloris", "PortScan", "FTP-Patator", "SSH-Patator", "Bot", "Web Attack - Brute Force", "Infiltration", "Heartbleed", " Web Attack XSS", "Something")
_MEANT = ("Benign", "DDoS", "DoS", "DoS", "DoS", "Port Scan", "Brute Force", "Brute Force", "Botnet", "Brute Force", "Infiltration", "Heartbleed", "Web Attack", "Other")
on_planted(
    "p7_category", lambda l: l.select("rec_id", S.category(F.element_at(F.array(*map(F.lit, _RAW)), (F.col("rec_id") % len(_RAW) + 1).cast("int"))).alias("category")),
    f"SELECT rec_id, list_extract({list(_MEANT)}, (rec_id % {len(_RAW)})::INTEGER + 1) AS category FROM logs",
)
on_planted("p8_unsw_category", lambda l: l.select("rec_id", S.unsw_category(F.when(F.col("status") == 401, " Backdoors").when(F.col("rec_id") % 2 == 0, "nan").otherwise(F.col("attack_category"))).alias("category")), "SELECT rec_id, CASE WHEN status = 401 THEN 'Backdoor' WHEN rec_id % 2 = 0 THEN 'Benign' ELSE attack_category END AS category FROM logs")
on_planted("p9_attack_flag", lambda l: l.select("rec_id", (F.upper("attack_category") != "BENIGN").alias("is_attack")), "SELECT rec_id, upper(attack_category) <> 'BENIGN' AS is_attack FROM logs")
on_planted("p10_numeric", lambda l: l.select("rec_id", S.numeric_component(F.col("endpoint")).alias("number")), r"SELECT rec_id, try_cast(nullif(regexp_extract(endpoint, '[/_\-](\d+)(?:[/?#]|$)', 1), '') AS BIGINT) AS number FROM logs")
_HIT = {f: f"regexp_matches(url_decode(endpoint), '(?i){p.replace(chr(39), chr(39) * 2)}')::INTEGER" for f, p in S.INJECTION.items()}
on_planted("p11_injection", lambda l: l.select("rec_id", *(S.injection(F.col("endpoint"), f).alias(f) for f in S.INJECTION)), f"SELECT rec_id, {', '.join(e + ' AS ' + f for f, e in _HIT.items())} FROM logs")
_NUM = "(split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT)"
on_planted("p12_private", lambda l: l.select("rec_id", S.ip_number(F.col("ip")).alias("number"), S.is_private(F.col("ip")).alias("private")), f"SELECT rec_id, {_NUM} AS number, ip LIKE '10.%' OR ip LIKE '203.0.113.%' OR ip LIKE '198.51.100.%' AS private FROM logs")
on_planted("p13_off_hours", lambda l: l.select("rec_id", S.off_hours(F.col("ts")).alias("off")), "SELECT rec_id, (sec // 3600) % 24 < 6 AS off FROM logs")
on_planted("p14_confidence", lambda l: l.select("rec_id", S.confidence_level(F.col("latency") / 1000).alias("level")), "SELECT rec_id, CASE WHEN latency / 1000 >= 0.75 THEN 'HIGH' WHEN latency / 1000 >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM logs")
on_planted("p15_dotted_quad", lambda l: l.filter(S.ip_number(F.col("ip")).isNotNull()).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM logs WHERE regexp_matches(ip, '^[0-9]{1,3}([.][0-9]{1,3}){3}$')")
add("p16_timestamps", lambda s, d: table(s, d, "events").select(F.col("event_id").alias("rec_id"), F.unix_seconds(F.try_to_timestamp(F.date_format(F.col("ts").cast("timestamp"), "MM/dd/yy HH:mm"), F.lit("MM/dd/yy HH:mm"))).alias("sec")), "SELECT event_id AS rec_id, (epoch(ts)::BIGINT - epoch(ts)::BIGINT % 60) AS sec FROM (SELECT event_id, date_trunc('second', ts::TIMESTAMP) AS ts FROM events)")
add("p17_request_path", lambda s, d: table(s, d, "pages").select("page_id", S.request_path(F.concat("url", F.lit(" HTTP/1.1")), F.lit("a=1")).alias("path")), "SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || '?a=1' AS path FROM pages")
on_planted("p18_port_endpoint", lambda l: l.select("rec_id", S.port_endpoint(F.when(F.col("status") == 401, "0x1f").otherwise(S.port(F.col("endpoint")).cast("string"))).alias("ep")), f"SELECT rec_id, CASE WHEN status = 401 THEN '/port_unknown' WHEN {PORT} IS NULL THEN '/port_0' ELSE '/port_' || {PORT} END AS ep FROM logs")
add("p20_owasp", lambda s, d: V.events(s, d).select("rec_id", S.owasp(F.when(F.col("rec_id") % 3 == 0, "/API/User/7").when(F.col("rec_id") % 3 == 1, "/v1/login").otherwise(F.col("endpoint"))).alias("context")), "SELECT rec_id, CASE rec_id % 3 WHEN 0 THEN 'API1' WHEN 1 THEN 'API2' END AS context FROM ev", V.EVENTS)
on_planted("p21_port_class", lambda l: l.select("rec_id", S.port(F.col("endpoint")).isin(*S.BENIGN_SERVICE_PORTS).alias("benign"), (S.port(F.col("endpoint")) >= EPHEMERAL).alias("ephemeral")), f"SELECT rec_id, p IN {S.BENIGN_SERVICE_PORTS} AS benign, p >= {EPHEMERAL} AS ephemeral FROM (SELECT rec_id, {PORT} AS p FROM logs)")

# Features (A, O)
IPS = "ips AS (SELECT batch_id, ip, count(*) AS n, min(rec_id) AS first, sum(latency) AS lat FROM logs GROUP BY ALL)"
A1 = f"a1 AS (SELECT batch_id, sum(n)::BIGINT AS total, count(*) AS unique_ips, arg_max(ip, {KEY}) AS top_ip, max(n) AS top_count, max(n) / sum(n)::DOUBLE AS dominant_ratio, sum(lat) / sum(n)::DOUBLE AS avg_latency FROM ips GROUP BY batch_id)"
PR = f"pr AS (SELECT *, sum(n) OVER (PARTITION BY batch_id, endpoint) AS ep_total, coalesce({PORT}, 0) IN (80, 8080, 8000) AS slow FROM (SELECT batch_id, ip, endpoint, count(*) AS n, min(rec_id) AS first, sum(latency) AS lat, count(*) FILTER (latency >= 9000) AS capped FROM logs GROUP BY ALL))"
A3 = f"""a3 AS (SELECT batch_id, arg_max(ip, {KEY}) AS pair_ip, arg_max(endpoint, {KEY}) AS pair_endpoint, arg_max(n, {KEY}) AS pair_count, arg_max(n / ep_total::DOUBLE, {KEY}) AS saturation,
 coalesce(arg_max(n, {KEY}) FILTER (slow), 0) AS slow_count, coalesce(arg_max(n / ep_total::DOUBLE, {KEY}) FILTER (slow), 0.0) AS slow_saturation, coalesce(arg_max(lat / n, {KEY}) FILTER (slow), 0.0) AS slow_latency, coalesce(arg_max(capped / n::DOUBLE, {KEY}) FILTER (slow), 0.0) AS slow_cap_ratio FROM pr GROUP BY batch_id)"""
A5 = "a5 AS (SELECT *, failures >= 1 AND total >= 20 AND successes / total::DOUBLE BETWEEN 0.01 AND 0.08 AS stuffing, failures >= 1 AND failures / total::DOUBLE >= 0.8 AND total >= 5 AS mostly_failing FROM (SELECT batch_id, ip, count(*) AS total, count(*) FILTER (status IN (401, 403)) AS failures, count(*) FILTER (status = 200) AS successes, min(rec_id) AS first FROM logs GROUP BY ALL))"
A8 = f"""a8 AS (SELECT batch_id, ip, sum(n)::BIGINT AS requests, round(-sum(p * log2(p)), 4) + 0.0 AS entropy, count(*) AS n_distinct, min(first) AS first FROM (SELECT *, n / sum(n) OVER (PARTITION BY batch_id, ip)::DOUBLE AS p FROM
 (SELECT batch_id, ip, endpoint, count(*) AS n, min(rec_id) AS first FROM logs WHERE coalesce({PORT} < {EPHEMERAL}, TRUE) GROUP BY ALL)) GROUP BY batch_id, ip HAVING sum(n) >= 5)"""
A9 = "a9 AS (SELECT batch_id, max(entropy) AS max_entropy, arg_max(ip, entropy * 1000000000000 - first) AS entropy_ip, arg_max(n_distinct, entropy * 1000000000000 - first) AS entropy_distinct FROM a8 GROUP BY batch_id)"
_FAM = list(S.INJECTION)
A10 = f"a10 AS (SELECT *, ({' + '.join(_FAM)})::BIGINT AS hits, ({' + '.join(f'({f} > 0)::INTEGER' for f in _FAM)}) AS families FROM (SELECT batch_id, ip, min(rec_id) AS first, {', '.join(f'sum({e})::BIGINT AS {f}' for f, e in _HIT.items())} FROM logs GROUP BY ALL))"
A12 = f"a12 AS (SELECT batch_id, ip, coalesce(max((p < 1024)::INTEGER), 0) AS low_port, count(DISTINCT CASE WHEN p IS NULL OR (p >= 1024 AND p < {EPHEMERAL} AND p NOT IN {S.BENIGN_SERVICE_PORTS}) THEN endpoint END) AS unusual, count(*) AS requests, bool_or(starts_with(endpoint, '/port_')) AS any_port FROM (SELECT batch_id, ip, endpoint, {PORT} AS p FROM logs) GROUP BY ALL)"
A13 = "a13 AS (SELECT batch_id, avg(CASE WHEN (sec // 3600) % 24 < 6 THEN 1.0 ELSE 0.0 END) AS off_hours_ratio, (max(sec) - min(sec)) * 1000 AS span_ms FROM logs GROUP BY batch_id)"
CATS = "cats AS (SELECT batch_id, attack_category, count(*) AS n, min(rec_id) AS first FROM logs GROUP BY ALL)"
A17 = f"a17 AS (SELECT batch_id, coalesce(sum(n) FILTER (attack_category <> 'Benign'), 0) / sum(n)::DOUBLE AS attack_ratio, arg_max(attack_category, {KEY}) AS majority, arg_max(attack_category, {KEY}) FILTER (attack_category <> 'Benign') AS dominant_attack FROM cats GROUP BY batch_id)"
GAPS = "gaps AS (SELECT * FROM (SELECT batch_id, ip, rec_id, sec, (sec - lag(sec) OVER (PARTITION BY batch_id, ip ORDER BY sec, rec_id)) * 1000 AS gap_ms FROM logs) WHERE gap_ms IS NOT NULL)"
O2 = "o2 AS (SELECT batch_id, ip, max(run) AS streak FROM (SELECT batch_id, ip, k, count(*) FILTER (status <> 200) AS run FROM (SELECT *, sum((status = 200)::INTEGER) OVER (PARTITION BY batch_id, ip ORDER BY sec, rec_id) AS k FROM logs WHERE status IN (200, 401, 403)) GROUP BY ALL) GROUP BY batch_id, ip)"
O3 = "o3 AS (SELECT * FROM (SELECT batch_id, ip, rec_id, endpoint AS a, lead(endpoint) OVER (PARTITION BY batch_id, ip ORDER BY sec, rec_id) AS b, ip_rank FROM logs JOIN (SELECT batch_id, ip, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, first) AS ip_rank FROM ips) USING (batch_id, ip)) WHERE ip_rank <= 30 AND b IS NOT NULL)"
O5 = "o5 AS (SELECT * FROM (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, first) AS rn, a, b, n, n / sum(n) OVER (PARTITION BY batch_id)::DOUBLE AS share FROM (SELECT batch_id, a, b, count(*) AS n, min(rec_id) AS first FROM o3 GROUP BY ALL)) WHERE rn <= 20)"
O6 = r"""o6 AS (SELECT batch_id, ip, max(run) AS run FROM (SELECT batch_id, ip, k, count(*) AS run FROM (SELECT batch_id, ip, sum(CASE WHEN d BETWEEN 1 AND 2 THEN 0 ELSE 1 END) OVER (PARTITION BY batch_id, ip ORDER BY sec, rec_id) AS k FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY batch_id, ip ORDER BY sec, rec_id)) AS d FROM
 (SELECT batch_id, ip, sec, rec_id, try_cast(nullif(regexp_extract(endpoint, '[/_\-](\d+)(?:[/?#]|$)', 1), '') AS BIGINT) AS v FROM logs) WHERE v BETWEEN 1 AND 10000)) GROUP BY ALL) GROUP BY batch_id, ip)"""
O8 = f"o8 AS (SELECT batch_id, ip, max(p - least(0.0, low)) AS peak FROM (SELECT *, min(p) OVER (PARTITION BY batch_id, ip ORDER BY sec, rec_id) AS low FROM (SELECT *, sum(({HUMAN_MEAN_MS} - gap_ms) / (sd + 0.000001) - 0.5) OVER (PARTITION BY batch_id, ip ORDER BY sec, rec_id) AS p FROM (SELECT *, stddev_pop(gap_ms) OVER (PARTITION BY batch_id, ip) AS sd, count(*) OVER (PARTITION BY batch_id, ip) AS c FROM gaps) WHERE c >= 6)) GROUP BY batch_id, ip)"
T4 = "t4 AS (SELECT batch_id, ip, first, gaps, median_gap, coalesce(CASE WHEN sd = 0 THEN 0.99 ELSE greatest(0.0, least(1.0, 1 - sd / mean)) END, 0.0) AS bot_conf FROM (SELECT batch_id, ip, min(rec_id) AS first, count(*) AS gaps, avg(gap_ms) AS mean, stddev_pop(gap_ms) AS sd, median(gap_ms) AS median_gap FROM gaps GROUP BY ALL) WHERE gaps + 1 >= 10)"

rounded = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
on_planted("a1_volume_profile", A.volume_profile, "SELECT * FROM a1", IPS, A1)
on_planted("a2_top_endpoints", lambda l: A.top_k(l, "endpoint"), "SELECT * FROM (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, first) AS rn, endpoint, n FROM (SELECT batch_id, endpoint, count(*) AS n, min(rec_id) AS first FROM logs GROUP BY ALL)) WHERE rn <= 10")
on_planted("a3_a4_saturation", A.saturation, "SELECT * FROM a3", PR, A3)
on_planted("a5_a7_auth_profile", A.auth_profile, "SELECT * FROM a5", A5)
on_planted("a8_entropy", lambda l: A.entropy_profile(l).withColumn("entropy", F.round("entropy", 3)), "SELECT * REPLACE (round(entropy, 3) AS entropy) FROM a8", A8)
on_planted("a9_max_entropy", lambda l: A.max_entropy(l).select("batch_id", F.round("max_entropy", 3).alias("max_entropy")), "SELECT batch_id, round(max_entropy, 3) AS max_entropy FROM a9", A8, A9)
on_planted("a10_injections", A.injections, "SELECT * FROM a10", A10)
on_planted("a11_distinct_endpoints", A.distinct_endpoints, "SELECT batch_id, count(DISTINCT endpoint) AS endpoints FROM logs GROUP BY batch_id")
on_planted("a12_port_signature", A.port_signature, "SELECT * FROM a12", A12)
on_planted("a13_spans", A.spans, "SELECT * FROM a13", A13)
on_planted("a17_truth", A.truth, "SELECT * FROM a17", CATS, A17)
on_planted("a17_category_shares", A.category_shares, "SELECT batch_id, attack_category, n / sum(n) OVER (PARTITION BY batch_id)::DOUBLE AS share FROM cats", CATS)
TRI = f"tri AS (SELECT s.*, head_share FROM (SELECT batch_id, count(*) FILTER (status IN (401, 403)) AS auth_errors, (max(sec) - min(sec)) * 1000 AS span_ms, count(DISTINCT endpoint) AS endpoints, bool_or(ip IN {BAD}) AS known_bad FROM logs GROUP BY batch_id) s JOIN (SELECT batch_id, max(n) / sum(n)::DOUBLE AS head_share FROM (SELECT batch_id, ip, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY rec_id) AS nth FROM logs) WHERE nth <= 50 GROUP BY ALL) GROUP BY batch_id) USING (batch_id))"
on_planted("a18_o10_triage_observations", lambda l: A.triage_observations(l, BAD), "SELECT * FROM tri", TRI)
on_planted("o1_gaps", A.gaps, "SELECT * FROM gaps", GAPS)
on_planted("o2_failure_streaks", A.failure_streaks, "SELECT * FROM o2", O2)
on_planted("o3_o4_transitions", A.transitions, "SELECT * FROM o3", IPS, O3)
on_planted("o5_transition_shares", A.transition_shares, "SELECT * FROM o5", IPS, O3, O5)
on_planted("o6_sequential_runs", A.sequential_runs, "SELECT * FROM o6", O6)
on_planted("o8_cusum", lambda l: A.cusum(l).withColumn("peak", F.round("peak", 2)), "SELECT batch_id, ip, round(peak, 2) AS peak FROM o8", GAPS, O8)
TRAVEL = f"travel AS (SELECT session, c1, country AS c2, gap, sec FROM (SELECT session, country, day * 86400 AS sec, lag(country) OVER w AS c1, (day - lag(day) OVER w) * 86400 AS gap FROM geo WINDOW w AS (PARTITION BY session ORDER BY day, country)) WHERE c1 <> country AND gap < 172800)"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.geo(spark, sf_dir).select("session", "country", (F.col("day") * 86400).alias("sec"), F.col("country").alias("rec_id"))


add("o9_impossible_travel", lambda s, d: A.impossible_travel(visits(s, d), 2880), "SELECT * FROM travel", V.GEO, TRAVEL)
PERIOD = """pg AS (SELECT batch_id, ip, row_number() OVER w - 2 AS i, (sec - lag(sec) OVER w) * 1000.0::DOUBLE AS gap, count(*) OVER (PARTITION BY batch_id, ip) - 1 AS n FROM logs WINDOW w AS (PARTITION BY batch_id, ip ORDER BY sec)),
ps AS (SELECT * FROM pg WHERE gap IS NOT NULL AND n >= 7),
pk AS (SELECT batch_id, ip, k, any_value(n) AS n, sqrt(pow(sum(gap * cos(2 * pi() * k * i / n)), 2) + pow(sum(gap * sin(2 * pi() * k * i / n)), 2)) AS height FROM ps JOIN range(1, 251) r(k) ON k <= n // 2 GROUP BY batch_id, ip, k),
per AS (SELECT batch_id, ip, round(CASE WHEN stddev_pop(gap) < 1e-9 THEN min(gap) ELSE any_value(n) / any_value(peak)::DOUBLE * avg(gap) END, 2) AS period_ms FROM ps JOIN (SELECT batch_id, ip, arg_max(k, round(height, 3) - k * 0.0000001) AS peak FROM pk GROUP BY ALL) USING (batch_id, ip) GROUP BY batch_id, ip)"""
on_planted("t4_period", A.dominant_period, "SELECT * FROM per", PERIOD)
LP = "lp AS (SELECT batch_id, ip, count(*) AS transitions, avg(log2(greatest(coalesce(expected, 0.01), 1e-10))) AS log_prob FROM o3 LEFT JOIN b6 USING (batch_id, a, b) GROUP BY ALL HAVING count(*) >= 4)"
B6 = "b6 AS (SELECT batch_id, a, b, share, CASE WHEN count(share) OVER w >= 5 THEN avg(share) OVER w END AS expected FROM o5 JOIN (SELECT DISTINCT batch_id, tenant FROM logs) USING (batch_id) WINDOW w AS (PARTITION BY tenant, a, b ORDER BY batch_id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING))"


def pair_baseline(logs: DataFrame) -> DataFrame:
    return B.transition_baseline(A.with_tenant(A.transition_shares(logs).select("batch_id", "a", "b", "share"), logs).select("tenant", "batch_id", "a", "b", "share"))


on_planted(
    "o7_log_probability", lambda l: A.log_probability(l, pair_baseline(l)).withColumn("log_prob", F.round("log_prob", 6)),
    "SELECT batch_id, ip, transitions, round(log_prob, 6) AS log_prob FROM lp", IPS, O3, O5, B6, LP,
)
on_planted("t4_t6_periodicity", lambda l: rounded(A.periodicity(l), "bot_conf"), "SELECT * REPLACE (round(bot_conf, 6) AS bot_conf) FROM t4", GAPS, T4)

# Statistical tests (T)
RATES = "rates AS (SELECT batch_id, endpoint, count(*) AS n FROM logs GROUP BY ALL)"
on_planted("t1_zscore", lambda l: rounded(T.zscore_last(l.groupBy("batch_id", "endpoint").agg(F.count("*").alias("n")), "endpoint", "batch_id", "n"), "z"),
    "SELECT endpoint, CASE WHEN c >= 4 THEN round((last - mean) / CASE WHEN coalesce(sd, 0) = 0 THEN 1e-9 ELSE sd END, 3) END AS z, coalesce(c >= 4 AND abs(round((last - mean) / CASE WHEN coalesce(sd, 0) = 0 THEN 1e-9 ELSE sd END, 3)) > 3, FALSE) AS significant FROM (SELECT endpoint, count(*) AS c, max(n) FILTER (back = 1) AS last, avg(n) FILTER (back > 1) AS mean, stddev_samp(n) FILTER (back > 1) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY batch_id DESC) AS back FROM rates) GROUP BY endpoint)", RATES)
on_planted("t2_ks", lambda l: T.ks(l.select(F.col("attack_category").alias("g"), F.col("latency").alias("v"), (F.col("batch_id") % 2 == 0).alias("first")), "g", "v", "first").select("g", F.round("statistic", 9).alias("statistic")),
    "SELECT g, round(max(abs(a / na - b / nb)), 9) AS statistic FROM (SELECT g, v, sum(x) OVER (PARTITION BY g ORDER BY v) AS a, sum(y) OVER (PARTITION BY g ORDER BY v) AS b, sum(x) OVER (PARTITION BY g)::DOUBLE AS na, sum(y) OVER (PARTITION BY g)::DOUBLE AS nb FROM (SELECT attack_category AS g, latency AS v, sum((batch_id % 2 = 0)::INTEGER) AS x, sum((batch_id % 2 = 1)::INTEGER) AS y FROM logs GROUP BY ALL)) WHERE na > 0 AND nb > 0 GROUP BY g")
on_planted("t3_mann_whitney", lambda l: T.mann_whitney(l.select(F.col("attack_category").alias("g"), F.col("latency").alias("v"), (F.col("batch_id") % 2 == 0).alias("first")), "g", "v", "first").select("g", "u"),
    "SELECT g, sum(CASE WHEN f THEN r ELSE 0.0 END) - n1 * (n1 + 1) / 2.0 AS u FROM (SELECT g, f, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r, sum(f::INTEGER) OVER (PARTITION BY g)::DOUBLE AS n1, count(*) OVER (PARTITION BY g) AS n FROM (SELECT attack_category AS g, latency AS v, batch_id % 2 = 0 AS f FROM logs)) WHERE n1 > 0 AND n1 < n GROUP BY g, n1")
on_planted(
    "t5_jaccard", lambda l: T.set_similarity(l, "batch_id", "endpoint", 30),
    "SELECT a.batch_id AS a, b.batch_id AS b, round(count(*) / (max(a.n) + max(b.n) - count(*))::DOUBLE, 4) AS similarity FROM e a JOIN e b ON a.endpoint = b.endpoint AND a.batch_id < b.batch_id GROUP BY a.batch_id, b.batch_id HAVING count(*) * 100 >= (max(a.n) + max(b.n) - count(*)) * 30",
    "e AS (SELECT DISTINCT batch_id, endpoint, count(DISTINCT endpoint) OVER (PARTITION BY batch_id) AS n FROM logs)",
)

# Baselines (B)
TN = "tn AS (SELECT batch_id, tenant, row_number() OVER (PARTITION BY tenant ORDER BY batch_id) AS batch_no FROM (SELECT DISTINCT batch_id, tenant FROM logs))"


def numbers(logs: DataFrame) -> DataFrame:
    """(tenant, batch_id, batch_no) of all batches."""
    return B.numbered(saved(logs.groupBy("batch_id").agg(F.min("tenant").alias("tenant")))).select("tenant", "batch_id", "batch_no")


def numbered_gaps(logs: DataFrame) -> DataFrame:
    """Gaps with their tenant and batch_no; many: of a client with six gaps or more."""
    return A.gaps(logs).withColumn("many", F.count("*").over(Window.partitionBy("batch_id", "ip")) >= 6).join(numbers(logs), "batch_id")


on_planted("b1_endpoint_rate", lambda l: rounded(B.running_mean(A.top_k(l, "endpoint"), "endpoint", "n"), "baseline"), "SELECT *, round(avg(n) OVER (PARTITION BY endpoint ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS baseline FROM (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, first) AS rn, endpoint, n FROM (SELECT batch_id, endpoint, count(*) AS n, min(rec_id) AS first FROM logs GROUP BY ALL)) WHERE rn <= 10")
on_planted("b2_b3_client_history", lambda l: rounded(B.running_mean(B.running_mean(A.auth_profile(l).select("batch_id", "ip", "total", "failures"), "ip", "failures", "failures_mean"), "ip", "total", "total_mean"), "failures_mean", "total_mean"), "SELECT batch_id, ip, total, failures, round(avg(failures) OVER w, 6) AS failures_mean, round(avg(total) OVER w, 6) AS total_mean FROM a5 WINDOW w AS (PARTITION BY ip ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", A5)
_T = "PARTITION BY tenant ORDER BY batch_id"
_W500 = f"OVER ({_T} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)"
_STAT = lambda m: f"CASE WHEN count({m}) {_W500} >= 5 THEN avg({m}) {_W500} END AS {m}_mean, CASE WHEN count({m}) {_W500} >= 5 THEN stddev_pop({m}) {_W500} END AS {m}_std"
on_planted(
    "b4_distribution", lambda l: rounded(B.distribution(A.with_tenant(A.volume_profile(l).select("batch_id", "top_count"), l), "top_count"), "top_count_mean", "top_count_std"),
    f"SELECT tenant, batch_id, top_count, round(top_count_mean, 6) AS top_count_mean, round(top_count_std, 6) AS top_count_std FROM (SELECT tenant, batch_id, top_count, {_STAT('top_count')} FROM a1 JOIN tn USING (batch_id))", IPS, A1, TN,
)
_VAR = lambda m, a, b: f"var_pop({m}) OVER ({_T} ROWS BETWEEN {a} PRECEDING AND {b})"
_OK = lambda *ms: f"coalesce(count(*) OVER ({_T}) >= 10 AND " + " AND ".join(f"({_VAR(m, 9, '5 PRECEDING')} = 0 OR abs({_VAR(m, 4, 'CURRENT ROW')} - {_VAR(m, 9, '5 PRECEDING')}) <= 0.05 * {_VAR(m, 9, '5 PRECEDING')})" for m in ms) + ", FALSE)"
on_planted("b5_stable", lambda l: B.stability(A.with_tenant(A.volume_profile(l).select("batch_id", "unique_ips"), l), ["unique_ips"]), f"SELECT tenant, batch_id, unique_ips, {_OK('unique_ips')} AS stable FROM a1 JOIN tn USING (batch_id)", IPS, A1, TN)
on_planted("b6_transition_baseline", lambda l: rounded(pair_baseline(l), "share", "expected"), "SELECT tenant, batch_id, a, b, round(share, 6) AS share, round(CASE WHEN count(share) OVER w >= 5 THEN avg(share) OVER w END, 6) AS expected FROM o5 JOIN tn USING (batch_id) WINDOW w AS (PARTITION BY tenant, a, b ORDER BY batch_id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)", IPS, O3, O5, TN)
_SEGMENT = f"CASE WHEN batch_no > {WARMUP - 1} THEN length(bin((batch_no - 1) // {WARMUP - 1})) ELSE 0 END"
POOL = f"""tg AS (SELECT tenant, batch_id, {_SEGMENT} AS segment, rec_id, gap_ms, count(*) OVER (PARTITION BY batch_id, ip) >= 6 AS many FROM gaps JOIN tn USING (batch_id)),
pool AS (SELECT * FROM (SELECT tenant, s.segment, rec_id, gap_ms, row_number() OVER (PARTITION BY tenant, s.segment ORDER BY md5(rec_id::VARCHAR), rec_id) AS rn
  FROM tg JOIN (SELECT tenant, unnest(range(1, max(segment) + 2)) AS segment FROM tg GROUP BY tenant) s USING (tenant) WHERE gap_ms > 0 AND tg.segment < s.segment) WHERE rn <= 2000)"""
KS = """kst AS (SELECT batch_id, ks, CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 21), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * x * x))))) END AS ks_p
  FROM (SELECT batch_id, ks, (sqrt(na * nb / (na + nb)) + 0.12 + 0.11 / sqrt(na * nb / (na + nb))) * ks AS x
    FROM (SELECT batch_id, max(abs(a / na - b / nb)) AS ks, max(na) AS na, max(nb) AS nb
      FROM (SELECT batch_id, sum(own) OVER w AS a, sum(other) OVER w AS b, sum(own) OVER (PARTITION BY batch_id)::DOUBLE AS na, sum(other) OVER (PARTITION BY batch_id)::DOUBLE AS nb
        FROM (SELECT batch_id, gap_ms, sum(own) AS own, sum(other) AS other FROM (
          SELECT batch_id, gap_ms, 1 AS own, 0 AS other FROM tg WHERE many AND segment > 0
          UNION ALL SELECT b.batch_id, p.gap_ms, 0, 1 FROM (SELECT DISTINCT tenant, segment, batch_id FROM tg WHERE many AND segment > 0) b JOIN pool p USING (tenant, segment) WHERE (tenant, segment) IN (SELECT (tenant, segment) FROM pool GROUP BY tenant, segment HAVING count(*) >= 200)) GROUP BY ALL)
        WINDOW w AS (PARTITION BY batch_id ORDER BY gap_ms)) WHERE na > 0 AND nb > 0 GROUP BY batch_id)))"""
on_planted("b7_gap_pool", lambda l: B.gap_pools(numbered_gaps(l)), "SELECT tenant, segment::INTEGER AS segment, rec_id, gap_ms FROM pool", GAPS, TN, POOL)
on_planted("d13_gap_tests", lambda l: B.gap_tests(numbered_gaps(l)).withColumn("ks_p", F.round("ks_p", 6)), "SELECT batch_id, round(ks, 9) AS ks, round(ks_p, 6) AS ks_p FROM kst", GAPS, TN, POOL, KS)
SPIKES = """spk AS (SELECT batch_id, avg(abs(z)) AS spike_z FROM (SELECT batch_id, rn, count(n) OVER w AS had, round((n - avg(n) OVER w) / CASE WHEN coalesce(stddev_samp(n) OVER w, 0) = 0 THEN 1e-9 ELSE stddev_samp(n) OVER w END, 3) AS z
  FROM (SELECT * FROM (SELECT batch_id, endpoint, n, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, first) AS rn FROM (SELECT batch_id, endpoint, count(*) AS n, min(rec_id) AS first FROM logs GROUP BY ALL)) JOIN tn USING (batch_id) WHERE rn <= 10)
  WINDOW w AS (PARTITION BY tenant, endpoint ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE rn <= 5 AND had >= 3 AND abs(z) > 3.5 GROUP BY batch_id)"""
ODD = """odd AS (SELECT batch_id, round((top - mean) / CASE WHEN coalesce(sd, 0) = 0 THEN 1e-9 ELSE sd END, 3) AS entropy_z FROM (SELECT batch_id, count(*) AS n, max(entropy) AS top, avg(entropy) FILTER (rn > 1) AS mean, stddev_samp(entropy) FILTER (rn > 1) AS sd
  FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY entropy DESC, first) AS rn FROM a8) GROUP BY batch_id) WHERE n >= 4)"""
on_planted("d8_rate_spikes", lambda l: A.rate_spikes(A.endpoint_counts(l)).withColumn("spike_z", F.round("spike_z", 3)), "SELECT batch_id, round(spike_z, 3) AS spike_z FROM spk", TN, SPIKES)
on_planted("d25_entropy_spikes", lambda l: A.entropy_spikes(A.entropy_profile(l)), "SELECT batch_id, entropy_z FROM odd", A8, ODD)
LAND = "land AS (SELECT 167772160 + s_suppkey AS lo, 167772160 + s_suppkey AS hi, 'C' || s_nationkey AS country FROM supplier)"
PLACES = f"places AS (SELECT batch_id, ip, country FROM (SELECT batch_id, ip, {_NUM} AS number FROM logs) LEFT JOIN land ON number BETWEEN lo AND hi)"
GPB = """gpb AS (SELECT k.batch_id, keys AS resolved_ips, keys, coalesce(countries, 0) AS countries, coalesce(foreign_share, 0) AS foreign_share, coalesce(top_foreign_share, 0) AS top_foreign_share, coalesce(countries, 0) AS foreign_countries, coalesce(countries / nullif(keys, 0)::DOUBLE, 0) AS diversity, FALSE AS tor_listed, FALSE AS home_known
  FROM (SELECT batch_id, count(DISTINCT ip) FILTER (country IS NOT NULL) AS keys FROM places GROUP BY batch_id) k
  LEFT JOIN (SELECT batch_id, count(*) AS countries, 1.0::DOUBLE AS foreign_share, max(n) / sum(n)::DOUBLE AS top_foreign_share FROM (SELECT batch_id, country, count(*) AS n FROM places WHERE country IS NOT NULL GROUP BY ALL) GROUP BY batch_id) c USING (batch_id))"""
FB = f"""fb AS (SELECT a1.*, tenant, batch_no, a3.* EXCLUDE (batch_id), failures, top_failures, stuffing_ips, failing_ips, coalesce(streak, 0) AS streak, hits, families, off_hours_ratio, span_ms, attack_ratio, majority, dominant_attack, endpoints, most_transitions, known_bad, coalesce(scan_signature, FALSE) AS scan_signature, coalesce(any_port, FALSE) AS any_port, coalesce(spike_z, 0.0) AS spike_z, coalesce(entropy_z, 0.0) AS entropy_z,
 coalesce(max_entropy, 0.0) AS max_entropy, coalesce(entropy_distinct, 0) AS entropy_distinct, coalesce(periodic_ips, 0) AS periodic_ips, coalesce(bot_conf, 0.0) AS bot_conf, coalesce(sequential_ips, 0) AS sequential_ips, coalesce(cusum_peak, 0.0) AS cusum_peak
 FROM a1 JOIN a3 USING (batch_id) JOIN tn USING (batch_id) JOIN (SELECT batch_id, max(failures) AS top_failures, sum(failures) AS failures, count(*) FILTER (stuffing) AS stuffing_ips, count(*) FILTER (mostly_failing) AS failing_ips FROM a5 GROUP BY batch_id) USING (batch_id)
 JOIN (SELECT batch_id, sum(hits) AS hits, arg_max(families, hits * 10000000000 - first) AS families FROM a10 GROUP BY batch_id) USING (batch_id) JOIN (SELECT batch_id, count(DISTINCT endpoint) AS endpoints, bool_or(ip IN {BAD}) AS known_bad FROM logs GROUP BY batch_id) USING (batch_id) JOIN (SELECT batch_id, max(n) - 1 AS most_transitions FROM ips GROUP BY batch_id) USING (batch_id) JOIN a13 USING (batch_id) JOIN a17 USING (batch_id)
 LEFT JOIN (SELECT batch_id, max(streak) AS streak FROM o2 GROUP BY batch_id) USING (batch_id) LEFT JOIN a9 USING (batch_id) LEFT JOIN (SELECT a12.batch_id, low_port = 1 AND unusual >= 20 AND requests >= 100 AS scan_signature, any_port FROM a12 JOIN a9 ON a12.batch_id = a9.batch_id AND a12.ip = a9.entropy_ip) USING (batch_id) LEFT JOIN spk USING (batch_id) LEFT JOIN odd USING (batch_id) LEFT JOIN (SELECT batch_id, count(*) FILTER (bot_conf > 0.85 AND median_gap >= 500) AS periodic_ips, max(bot_conf) FILTER (median_gap >= 500) AS bot_conf FROM t4 GROUP BY batch_id) USING (batch_id)
 LEFT JOIN (SELECT batch_id, count(*) FILTER (run >= 10) AS sequential_ips FROM o6 GROUP BY batch_id) USING (batch_id) LEFT JOIN (SELECT batch_id, max(peak) AS cusum_peak FROM o8 GROUP BY batch_id) USING (batch_id))"""
STATS = f"st AS (SELECT *, {', '.join(_STAT(m) for m in ('dominant_ratio', 'top_count', 'avg_latency', 'max_entropy', 'off_hours_ratio', 'periodic_ips'))}, {_OK('dominant_ratio', 'top_count', 'avg_latency')} AS stable, {_OK('max_entropy')} AS entropy_stable FROM fb)"
_LAST = lambda e, ok, cold: f"coalesce(last_value(CASE WHEN {ok} THEN {e} END IGNORE NULLS) OVER ({_T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {cold})"
CTX = f"""ctx AS (SELECT *, {_LAST('least(0.99, greatest(0.65, dominant_ratio_mean + 2 * dominant_ratio_std))', 'stable', '0.9')} AS thr_dominant, {_LAST('greatest(50.0, top_count_mean + 2 * top_count_std)', 'stable', '450.0')} AS thr_rate, {_LAST('avg_latency_mean + 3 * avg_latency_std', 'stable', '6500.0')} AS thr_latency,
 {_LAST('max_entropy_mean + 2 * max_entropy_std', 'entropy_stable', '2.0')} AS thr_entropy, {_LAST('least(0.99, off_hours_ratio_mean + 2 * off_hours_ratio_std)', 'off_hours_ratio_mean IS NOT NULL', '0.85')} AS thr_off_hours, {_LAST('greatest(2.0, floor(periodic_ips_mean) + 1)', 'periodic_ips_mean IS NOT NULL', '2.0')} AS thr_periodic,
 sum((endpoints >= 3 OR known_bad)::INTEGER) OVER ({_T}) AS dispatched, coalesce({PORT.replace('endpoint', 'pair_endpoint')}, 0) AS pair_port, gpb.* EXCLUDE (batch_id), coalesce(ks_p, 1.0) AS ks_p FROM st JOIN gpb USING (batch_id) LEFT JOIN kst USING (batch_id))"""
ALL = (TN, IPS, A1, PR, A3, A5, A8, A9, A10, A12, A13, CATS, A17, GAPS, O2, O6, O8, T4, SPIKES, ODD, POOL, KS, LAND, PLACES, GPB, FB, STATS, CTX)


def addresses(logs: DataFrame) -> DataFrame:
    """(ip, number) of all clients."""
    return saved(logs.select("ip").distinct()).withColumn("number", S.ip_number(F.col("ip")))


#: Addresses up to which their countries are broadcast (some 50 MB); beyond, a shuffled join.
BROADCAST_ADDRESSES = 1_000_000


def countries(clients: DataFrame, ranges: DataFrame) -> DataFrame:
    """(batch_id, key, country, n) of each client of a batch, clients(batch_id, ip, n), by J3 over the distinct addresses."""
    known = saved(T.range_lookup(addresses(clients), ranges, "number").select("ip", "country"))
    known = F.broadcast(known) if known.count() <= BROADCAST_ADDRESSES else known
    return clients.join(known, "ip", "left").select("batch_id", F.col("ip").alias("key"), "country", "n")


def context(logs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Features once for all detectors."""
    return context_of(saved(A.batch_profile(logs, BAD)), ranges)


def context_of(profile: DataFrame, ranges: DataFrame) -> DataFrame:
    geo = D.geo_features(countries(clients_of(profile), ranges), once=True)
    return saved(D.with_context(saved(A.features_of(profile)), geo))


def clients_of(profile: DataFrame) -> DataFrame:
    """(batch_id, ip, n) from a written profile: each client of a batch once."""
    return profile.select("batch_id", F.inline("clients"))


_B8 = ("thr_dominant", "thr_rate", "thr_latency", "thr_off_hours", "thr_periodic", "thr_entropy")
on_planted("b8_b9_thresholds", lambda l, r: rounded(context(l, r).select("batch_id", "batch_no", "dispatched", *_B8), *_B8), f"SELECT batch_id, batch_no, dispatched, {', '.join(f'round({c}, 6) AS {c}' for c in _B8)} FROM ctx", *ALL)

# Detectors (D): SQL of its own in detector_sql
_NAMES = {"volume": "d1_d10_volume", "temporal": "d11_d15_temporal", "auth": "d17_d20_auth", "payload": "d21_d26_payload", "sequence": "d27_sequence", "geo": "d28_d32_batch_geo"}
for _agent, _name in _NAMES.items():
    _cte, _text, _least = Q.AGENTS[_agent]
    on_planted(_name, lambda l, r, a=_agent: D.detect(context(l, r), a), f"SELECT *, score >= {_least} AS fired FROM {_cte}", *ALL, _text)


def brute_force(logs: DataFrame) -> DataFrame:
    """The longest failure streak of each batch and its score."""
    s = A.failure_streaks(logs).groupBy("batch_id").agg(F.max("streak").alias("streak"))
    return s.select("batch_id", "streak", F.when(F.col("streak") >= 10, F.least(F.lit(1.0), F.col("streak") / 25.0 + 0.4)).otherwise(0.0).alias("score"))


on_planted("d18_brute_force", brute_force, "SELECT batch_id, max(streak) AS streak, CASE WHEN max(streak) >= 10 THEN least(1.0, max(streak) / 25.0 + 0.4) ELSE 0.0 END AS score FROM o2 GROUP BY batch_id", O2)
GF = """gf AS (SELECT k.*, resolved, countries, foreign_share, top_foreign_share, foreign_countries, keys / all_keys::DOUBLE AS coverage, countries / keys::DOUBLE AS diversity, FALSE AS tor_listed
  FROM (SELECT day // 500 AS batch_id, count(DISTINCT session) AS all_keys, count(DISTINCT session) AS keys FROM geo GROUP BY 1) k
  JOIN (SELECT batch_id, sum(n)::BIGINT AS resolved, count(*) AS countries, coalesce(sum(n) FILTER (country <> 'C1'), 0) / sum(n)::DOUBLE AS foreign_share, coalesce(max(n) FILTER (country <> 'C1'), 0) / sum(n)::DOUBLE AS top_foreign_share, count(*) FILTER (country <> 'C1') AS foreign_countries
    FROM (SELECT day // 500 AS batch_id, country, count(*) AS n FROM geo GROUP BY ALL) GROUP BY batch_id) USING (batch_id))"""


def session_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.geo_features(V.geo(spark, sf_dir).select(F.floor(F.col("day") / 500).alias("batch_id"), F.col("session").alias("key"), "country"), "C1")


add("a14_a16_geo_features", session_geo, "SELECT * FROM gf", V.GEO, GF)
add(
    "d28_d32_geo", lambda s, d: D.detect(session_geo(s, d).withColumns({"resolved_ips": F.col("keys"), "unique_ips": F.col("all_keys"), "home_known": F.lit(True)}), "geo"),
    "SELECT *, score >= 0.5 AS fired FROM gpl", V.GEO, GF, "ctx AS (SELECT *, keys AS resolved_ips, all_keys AS unique_ips, TRUE AS home_known FROM gf)", Q.GEO,
)
TOR = ("198.51.100.3", "203.0.113.6")
on_planted(
    "d29_tor_listed", lambda l: D.geo_features(l.select("batch_id", F.col("ip").alias("key"), F.lit(None).cast("string").alias("country")), None, l.sparkSession.createDataFrame([(x,) for x in TOR], "key string")).filter("tor_listed").select("batch_id", F.lit(0.75).alias("score")),
    f"SELECT DISTINCT batch_id, 0.75::DOUBLE AS score FROM logs WHERE ip IN {TOR}",
)
add(
    "d33_impossible_travel", lambda s, d: A.impossible_travel(visits(s, d), 2880).groupBy("session").agg(F.count("*").alias("changes")).withColumn("score", F.lit(0.8)),
    "SELECT session, count(*) AS changes, 0.8::DOUBLE AS score FROM travel GROUP BY session", V.GEO, TRAVEL,
)

# Fusion (F)
CP = "cp AS (SELECT batch_id, arg_max(meant, pos) AS compound_threat, max(boost)::DOUBLE AS boost, count(*) AS signals, array_agg(one || ' + ' || two ORDER BY pos) AS compound FROM (SELECT a.batch_id, pos, one, two, meant, boost FROM cf a JOIN (" + U._values(tuple((i, *r) for i, r in enumerate(U.COMPOUND)), "pos, one, two, meant, boost, low").replace("VALUES", "SELECT * FROM (VALUES", 1).replace(" AS t(", ") AS t(") + ") r ON a.threat = one JOIN cf b ON b.batch_id = a.batch_id AND b.threat = two WHERE a.score >= low AND b.score >= low) GROUP BY batch_id)"
CF = "cf AS (SELECT batch_id, threat, max(score) AS score FROM fn WHERE fired GROUP BY ALL)"
_PAIRS = "(SELECT d.agent, r.high, min(r.related) AS related FROM (SELECT * FROM " + U._values(U.RELATED, "high, related") + ") r JOIN (SELECT * FROM " + U._values(U.DOMAINS, "agent, threat") + ") d ON d.threat = r.related GROUP BY ALL)"
_PAIRS = _PAIRS.replace(" AS t(", " t(").replace("FROM VALUES", "FROM (VALUES").replace(" t(", ") t(")
CN = f"""cn AS (SELECT f.batch_id, f.agent, arg_min(related, nth) AS raised_threat, round(0.45 * arg_min(h.score, nth), 3) AS raised_score FROM fn f JOIN {_PAIRS} m ON f.agent = m.agent
 JOIN (SELECT *, list_position(['volume', 'temporal', 'auth', 'payload', 'sequence', 'geo'], agent) AS nth FROM fn WHERE fired AND score >= 0.75) h ON h.batch_id = f.batch_id AND h.threat = m.high WHERE NOT f.fired AND f.score >= 0.10 AND f.score < 0.45 GROUP BY ALL)"""
RS = "rs AS (SELECT batch_id, agent, coalesce(raised_score, score) AS score, coalesce(raised_threat, threat) AS threat, fired OR raised_score IS NOT NULL AS fired FROM fn LEFT JOIN cn USING (batch_id, agent))"
_ORDER = "list_position(['volume', 'temporal', 'auth', 'payload', 'sequence', 'geo'], agent)"
_WT = "CASE agent " + " ".join(f"WHEN '{a}' THEN {w}::DOUBLE" for a, w in U.WEIGHTS.items()) + " END"
VD = f"""vd AS (SELECT batch_id, is_attack, CASE WHEN is_attack THEN threat ELSE 'NONE' END AS threat, round(fused, 3) AS confidence, n_agents, agents, signals, compound, boost FROM (SELECT *, CASE WHEN n_agents = 0 THEN FALSE WHEN n_agents = 1 THEN best >= 0.8 ELSE fused >= 0.6 END AND threat <> 'NONE' AS is_attack FROM (
 SELECT f.batch_id, n_agents, best, agents, coalesce(least(1.0, ws / ww + coalesce(boost, 0.0)), 0.0) AS fused, coalesce(compound_threat, own, 'NONE') AS threat, coalesce(signals, 0) AS signals, coalesce(compound, []) AS compound, boost FROM (SELECT batch_id, sum({_WT} * score) FILTER (fired) AS ws, sum({_WT}) FILTER (fired) AS ww, count(*) FILTER (fired) AS n_agents, max(score) FILTER (fired) AS best,
 arg_max(threat, score * 1000 - {_ORDER}) FILTER (fired) AS own, coalesce(array_agg(agent ORDER BY agent) FILTER (fired), []) AS agents FROM rs GROUP BY batch_id) f LEFT JOIN cp USING (batch_id))))"""
FOUND = (*ALL, *Q.EACH, Q.RAW, Q.FINDINGS)
VERDICT = (*FOUND, CF, CP, CN, RS, VD)


def found(logs: DataFrame, ranges: DataFrame) -> DataFrame:
    return saved(D.findings(context(logs, ranges)))


on_planted("f1_triage", lambda l: U.triage(A.triage_observations(l, BAD)), "SELECT batch_id, TRUE AS volume, TRUE AS geo, known_bad OR auth_errors > 0 AS auth, known_bad OR span_ms > 200 AS temporal, known_bad OR endpoints >= 5 AS payload, known_bad OR endpoints >= 3 AS sequence FROM tri", TRI)
on_planted("f2_evidence", lambda l, r: U.evidence(found(l, r)), "SELECT batch_id, agent, lower(threat) || ':' || agent AS key, score AS confidence FROM fn WHERE fired", *FOUND)
on_planted(
    "f2_evidence_reads", lambda l, r: U.read_evidence(U.evidence(found(l, r)), key="dos", least=0.7, latest=True),
    "SELECT key, max(batch_id) AS batch_id, arg_max(confidence, batch_id) AS confidence FROM (SELECT batch_id, lower(threat) || ':' || agent AS key, score AS confidence FROM fn WHERE fired) WHERE key LIKE '%dos%' AND confidence >= 0.7 GROUP BY key", *FOUND,
)
on_planted("f3_compound", lambda l, r: U.compound_signals(saved(D.findings(context(l, r), suppress=False))), "SELECT * FROM cp", *ALL, *Q.EACH, Q.RAW, CF.replace("FROM fn", "FROM fr"), CP)
on_planted("f4_conflicts", lambda l, r: U.conflicts(found(l, r)), "SELECT * FROM cn", *FOUND, CN)
on_planted("f5_f8_verdicts", lambda l, r: U.fuse(found(l, r)), "SELECT * FROM vd", *VERDICT)
PLAN = "plan AS (SELECT batch_id, list_filter([CASE WHEN TRUE THEN 'volume' END, CASE WHEN known_bad OR span_ms > 200 THEN 'temporal' END, CASE WHEN known_bad OR auth_errors > 0 THEN 'auth' END, CASE WHEN known_bad OR endpoints >= 5 THEN 'payload' END, CASE WHEN known_bad OR endpoints >= 3 THEN 'sequence' END, 'geo'], lambda x: x IS NOT NULL) AS sent FROM tri)"
on_planted(
    "p22_explanations", lambda l, r: (lambda f: U.explained(U.fuse(f), f, U.triage(A.triage_observations(l, BAD))).select("batch_id", "explanation"))(found(l, r)),
    f"""SELECT batch_id, concat_ws(chr(10), CASE WHEN is_attack THEN 'ATTACK ' ELSE 'benign ' END || threat || ' confidence=' || printf('%.3f', confidence), nullif(array_to_string(list_transform(compound, lambda x: 'compound: ' || x), chr(10)), ''), 'triage: ' || array_to_string(sent, ', '), nullif(array_to_string(list_transform(coalesce(told, [])[1:3], lambda x: 'found: ' || x), chr(10)), '')) AS explanation
 FROM vd JOIN plan USING (batch_id) LEFT JOIN (SELECT batch_id, array_agg(agent || ' ' || threat || ' ' || score::VARCHAR ORDER BY {_ORDER}) AS told FROM rs WHERE fired GROUP BY batch_id) USING (batch_id)""", *VERDICT, TRI, PLAN,
)


def judged(logs: DataFrame, ranges: DataFrame, threshold: float = 0.05, inclusive: bool = False) -> DataFrame:
    return U.scores(U.fuse(found(logs, ranges)), A.truth(logs), threshold, inclusive)


_W = "[" + ", ".join(f"{U.WEIGHTS[a]}::DOUBLE" for a in sorted(U.WEIGHTS)) + "]"
_FLAGS = "list_transform(range(1, 7), lambda i: CASE WHEN len(past[i]) >= 20 THEN list_avg(list_transform(past[i], lambda v: v::INTEGER::DOUBLE)) ELSE 1.0 END)"
LEARNT = f"""ord AS (SELECT tn.tenant, tn.batch_no, tn.batch_id, list(rs.score ORDER BY agent) AS score, list(rs.fired ORDER BY agent) AS fired FROM rs JOIN tn USING (batch_id) GROUP BY ALL),
fold AS (
  SELECT tenant, 0::BIGINT AS batch_no, NULL::BIGINT AS batch_id, NULL::DOUBLE AS fused, NULL::BOOLEAN AS is_attack, [[]::BOOLEAN[], [], [], [], [], []] AS past FROM (SELECT DISTINCT tenant FROM ord)
  UNION ALL
  SELECT tenant, batch_no, batch_id, fused, mass > 0 AND fused >= 0.6, list_transform(range(1, 7), lambda i: CASE WHEN fired[i] THEN list_append(past[i], mass > 0 AND fused >= 0.6)[-100:] ELSE past[i] END)
  FROM (SELECT *, CASE WHEN mass > 0 THEN total / mass ELSE 0.0 END AS fused FROM (
    SELECT *, list_sum(list_transform(range(1, 7), lambda i: CASE WHEN fired[i] THEN w[i] * score[i] ELSE 0.0 END)) AS total, list_sum(list_transform(range(1, 7), lambda i: CASE WHEN fired[i] THEN w[i] ELSE 0.0 END)) AS mass FROM (
      SELECT o.*, past, list_transform(range(1, 7), lambda i: CASE WHEN p[i] = 1.0 THEN {_W}[i] ELSE p[i] END) AS w FROM (SELECT tenant, batch_no + 1 AS batch_no, past, {_FLAGS} AS p FROM fold) f JOIN ord o USING (tenant, batch_no)))))"""
on_planted("f6_b10_learned_fusion", lambda l, r: (lambda logs: U.learned_fusion(found(logs, r), numbers(logs)))(l), "SELECT tenant, batch_id, round(fused, 3) AS fused, is_attack FROM fold WHERE batch_no > 0", *VERDICT, LEARNT)
ORACLE["f6_b10_learned_fusion"] = ORACLE["f6_b10_learned_fusion"].replace("WITH ", "WITH RECURSIVE ", 1)
on_planted("f7_ml2_stacker", lambda l, r: (lambda logs: (lambda f: M.stacker(f, U.fuse(f), numbers(logs), tuple(U.WEIGHTS)))(found(logs, r)))(l))


def outliers(logs: DataFrame) -> DataFrame:
    """ML1 on the volume of batches; null for those before the first forest."""
    volumes = saved(A.volume_profile(logs).join(numbers(logs), "batch_id"))
    return volumes.select("batch_id").join(M.isolation(volumes, ["dominant_ratio", "top_count", "avg_latency"]), "batch_id", "left")


on_planted("d9_ml1_isolation", outliers)


def boosted(logs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings with volume's score raised for the forest's outliers."""
    logs = saved(logs)
    return D.boosted(found(logs, ranges), outliers(logs))


on_planted("d9_volume_boosted", lambda l, r: boosted(l, r))

# Reputation (K) and joins (J)
HIST = "hist AS (SELECT * FROM (SELECT batch_id, ip, is_attack, confidence, row_number() OVER (PARTITION BY ip ORDER BY batch_id DESC) AS rn FROM (SELECT DISTINCT batch_id, ip FROM logs) JOIN vd USING (batch_id)) WHERE rn <= 50)"


def history(logs: DataFrame, ranges: DataFrame) -> DataFrame:
    profile = saved(A.batch_profile(logs, BAD))
    return saved(U.ip_history(clients_of(profile), saved(U.fuse(saved(D.findings(context_of(profile, ranges))))), once=True))


on_planted("k1_j2_known_bad", lambda l: l.join(F.broadcast(bad_list(l.sparkSession)), "ip", "left_semi").groupBy("batch_id", "ip").agg(F.count("*").alias("n")), f"SELECT batch_id, ip, count(*) AS n FROM logs WHERE ip IN {BAD} GROUP BY ALL")
on_planted("j2_clean_traffic", lambda l: l.join(F.broadcast(bad_list(l.sparkSession)), "ip", "left_anti").groupBy("batch_id").agg(F.count("*").alias("n")), f"SELECT batch_id, count(*) AS n FROM logs WHERE ip NOT IN {BAD} GROUP BY ALL")
on_planted("k2_ip_history", lambda l, r: history(l, r), "SELECT batch_id, ip, is_attack, confidence, rn FROM hist", *VERDICT, HIST)
on_planted("k3_k5_reputation", lambda l, r: U.reputation(history(l, r), bad_list(l.sparkSession)),
    f"SELECT ip, ip IN {BAD} AS known_bad, round(coalesce(prior, CASE WHEN ip IN {BAD} THEN 0.85 ELSE 0.0 END), 6) AS prior, attacks, attacks >= 3 AND current >= 0.7 AS repeat_offender, CASE WHEN attacks >= 3 AND current >= 0.7 THEN least(1.0, 0.5 + 0.1 * attacks) ELSE 0.0 END AS repeat_confidence FROM (SELECT ip, sum(confidence * pow(0.95, rn - 1)) FILTER (is_attack) / sum(pow(0.95, rn - 1)) FILTER (is_attack) AS prior, count(*) FILTER (is_attack) AS attacks, arg_max(confidence, batch_id) AS current FROM hist GROUP BY ip)", *VERDICT, HIST)
_PRIOR = f"round(coalesce(prior, CASE WHEN ip IN {BAD} THEN 0.85 ELSE 0.0 END), 6)"
ASKED = f"asked AS (SELECT ip, min(endpoint) AS endpoint FROM logs GROUP BY ip UNION ALL SELECT '192.0.2.1', '/api/user/7')"


def answers(logs: DataFrame, ranges: DataFrame) -> DataFrame:
    """K5 for every client and one that has never been seen."""
    spark, logs = logs.sparkSession, saved(logs)
    h = history(logs, ranges)
    asked = logs.groupBy("ip").agg(F.min("endpoint").alias("endpoint")).unionByName(spark.createDataFrame([("192.0.2.1", "/api/user/7")], "ip string, endpoint string"))
    return U.reputation_answer(U.reputation(h, bad_list(spark)), h, asked)


on_planted(
    "k5_answers", lambda l, r: answers(l, r),
    f"""SELECT ip, endpoint, ip IN {BAD} AS known_bad, round(coalesce({_PRIOR}, 0.0), 3) AS prior_confidence, CASE WHEN ip NOT IN {BAD} AND total IS NULL THEN 'No prior activity on record.' ELSE concat_ws(' ', CASE WHEN ip IN {BAD} THEN 'IP is in known-bad seed list.' END,
 CASE WHEN total > 0 THEN 'Seen in ' || total || ' prior batch(es); ' || attacks || ' flagged as attack.' END, CASE WHEN attacks >= 3 THEN 'Repeat offender \u2014 escalated pre-emptive confidence.' END) END AS history_summary,
 CASE WHEN regexp_matches(lower(endpoint), '/(user|account|profile|order)/') THEN 'API1' WHEN regexp_matches(lower(endpoint), '/(login|auth|token|session)') THEN 'API2' END AS owasp_context
 FROM asked LEFT JOIN (SELECT ip, sum(confidence * pow(0.95, rn - 1)) FILTER (is_attack) / sum(pow(0.95, rn - 1)) FILTER (is_attack) AS prior, count(*) FILTER (is_attack) AS attacks, count(*) AS total FROM hist GROUP BY ip) USING (ip)""", *VERDICT, HIST, ASKED,
)
FLAGS = (("198.51.100.3", False, True, True, "AS64500"), ("203.0.113.6", True, None, False, "AS64501"))
on_planted(
    "k6_ip_flags", lambda l: D.ip_flags(l, l.sparkSession.createDataFrame(FLAGS, "ip string, datacenter boolean, vpn boolean, tor boolean, asn string")),
    "SELECT ip, coalesce(datacenter, FALSE) AS datacenter, coalesce(vpn, FALSE) AS vpn, coalesce(tor, FALSE) AS tor, coalesce(asn, 'UNKNOWN') AS asn FROM (SELECT DISTINCT ip FROM logs) LEFT JOIN (VALUES ('198.51.100.3', FALSE, TRUE, TRUE, 'AS64500'), ('203.0.113.6', TRUE, NULL, FALSE, 'AS64501')) f(ip, datacenter, vpn, tor, asn) USING (ip)",
)
add(
    "j3_s17_country_ranges", lambda s, d: T.range_lookup(addresses(V.planted(s, d)), V.country_ranges(s, d), "number"),
    "SELECT DISTINCT ip, number, country FROM (SELECT ip, " + _NUM + " AS number FROM logs) JOIN land ON number BETWEEN lo AND hi", V.PLANTED, LAND,
)
NETS = """nets AS (
  SELECT 167772160::BIGINT AS lo, 184549375::BIGINT AS hi, 'W' || r_regionkey AS country FROM region WHERE r_regionkey = 0
  UNION ALL SELECT 167772160, 167837695, 'X' || r_regionkey FROM region WHERE r_regionkey = 1
  UNION ALL SELECT 167772160 + s_suppkey, 167772160 + s_suppkey + 255, 'Y' || s_nationkey FROM supplier WHERE s_suppkey % 512 = 0
  UNION ALL SELECT 167772160 + s_suppkey - 3, 167772160 + s_suppkey + 9, 'Z' || s_nationkey FROM supplier WHERE s_suppkey % 20 = 0
  UNION ALL SELECT 167772160 + s_suppkey, 167772160 + s_suppkey, 'C' || s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)"""
add(
    "j3_longest_match", lambda s, d: T.range_lookup(addresses(V.planted(s, d)), V.networks(s, d), "number"),
    "SELECT ip, number, arg_min(country, (hi - lo) * 10000000000 + lo) AS country FROM (SELECT DISTINCT ip, " + _NUM + " AS number FROM logs) JOIN nets ON number BETWEEN lo AND hi GROUP BY ip, number", V.PLANTED, NETS,
)
LATEST = "base AS (SELECT ip, sec - sec % 21600 + 21600 AS hour, round(avg(latency), 6) AS baseline, max(rec_id) AS as_of FROM ev WHERE status = 200 GROUP BY ALL)"


def latest_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, its time to the hour, with the newest closed six hours of its client."""
    e = V.events(spark, sf_dir)
    base = e.filter("status = 200").groupBy("ip", (F.col("sec") - F.col("sec") % 21600 + 21600).alias("hour")).agg(F.round(F.avg("latency"), 6).alias("baseline"), F.max("rec_id").alias("as_of"))
    return J.as_of(e.select("rec_id", "ip", (F.col("sec") - F.col("sec") % 3600).alias("hour")), base, "ip", "hour", "as_of")


add("j7_as_of_baseline", latest_baselines, "SELECT rec_id, e.ip, e.hour, baseline, as_of FROM (SELECT rec_id, ip, sec - sec % 3600 AS hour FROM ev) e ASOF LEFT JOIN base ON e.ip = base.ip AND e.hour >= base.hour", V.EVENTS, LATEST)
add(
    "j8_around_failures", lambda s, d: (lambda e: J.within(e.filter("status = 401").select(F.col("rec_id").alias("anchor_id"), "ip", "us"), e, "ip", 43_200_000_000, 3_600_000_000))(V.events(s, d)),
    "SELECT a.rec_id AS anchor_id, r.rec_id, a.us - r.us AS lag FROM ev a JOIN ev r ON a.ip = r.ip AND r.us BETWEEN a.us - 43200000000 AND a.us + 3600000000 WHERE a.status = 401", V.EVENTS,
)


def sketches(logs: DataFrame) -> DataFrame:
    """A11 and A16 by sketches of batches that are united by tenant: exact counts, and whether the estimates are within 3 %."""
    united = T.sketched(logs, ["tenant", "batch_id"], ["endpoint", "ip"]).groupBy("tenant").agg(*(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"{c}_about") for c in ("endpoint", "ip")))
    exact = logs.groupBy("tenant").agg(F.countDistinct("endpoint").alias("endpoints"), F.countDistinct("ip").alias("ips"))
    near = lambda about, n: (F.abs(F.col(about) - F.col(n)) <= F.greatest(F.lit(1.0), 0.03 * F.col(n))).alias(f"{n}_near")
    return exact.join(united, "tenant").select("tenant", "endpoints", "ips", near("endpoint_about", "endpoints"), near("ip_about", "ips"))


on_planted("a11_a16_sketches", sketches, "SELECT tenant, count(DISTINCT endpoint) AS endpoints, count(DISTINCT ip) AS ips, TRUE AS endpoints_near, TRUE AS ips_near FROM logs GROUP BY tenant")
on_planted("j5_record_verdicts", lambda l, r: (lambda logs: logs.join(U.fuse(found(logs, r)).select("batch_id", "is_attack"), "batch_id").groupBy("attack_category", "is_attack").agg(F.count("*").alias("n")))(l), "SELECT attack_category, is_attack, count(*) AS n FROM logs JOIN vd USING (batch_id) GROUP BY ALL", *VERDICT)
on_planted("x3_x5_sets", lambda l: l.groupBy("batch_id").agg(F.sort_array(F.collect_set("attack_category")).alias("present")).select("batch_id", F.array_except(F.array(F.lit("Benign"), F.lit("DoS"), F.lit("DDoS")), "present").alias("absent"), (F.size(F.array_except(F.array(F.lit("Benign")), "present")) == 0).alias("has_benign")), "SELECT batch_id, list_filter(['Benign', 'DoS', 'DDoS'], lambda x: NOT list_contains(present, x)) AS absent, list_contains(present, 'Benign') AS has_benign FROM (SELECT batch_id, array_agg(DISTINCT attack_category) AS present FROM logs GROUP BY batch_id)")

# Evaluation (E)
SC = "sc AS (SELECT vd.batch_id, is_attack, threat AS predicted, confidence, agents, attack_ratio, majority, dominant_attack, attack_ratio > 0.05 AS is_true FROM vd JOIN a17 USING (batch_id))"
_RATE = lambda a, b: f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0.0), 4)"
CONF = f"tp, fp, fn, tn, {_RATE('tp', 'tp + fp')} AS precision, {_RATE('tp', 'tp + fn')} AS recall, {_RATE('2 * tp', '2 * tp + fp + fn')} AS f1, {_RATE('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_RATE('fp', 'fp + tn')} AS fpr"
COUNT = "count(*) FILTER (is_attack AND is_true) AS tp, count(*) FILTER (is_attack AND NOT is_true) AS fp, count(*) FILTER (NOT is_attack AND is_true) AS fn, count(*) FILTER (NOT is_attack AND NOT is_true) AS tn"
EVAL = (*VERDICT, SC)
on_planted("e1_scored", lambda l, r: judged(l, r), "SELECT * FROM sc", *EVAL)
on_planted("e2_confusion", lambda l, r: U.confusion(judged(l, r)), f"SELECT {CONF} FROM (SELECT {COUNT} FROM sc)", *EVAL)
on_planted("e3_by_majority", lambda l, r: U.confusion(judged(l, r), "majority"), f"SELECT majority, {CONF} FROM (SELECT majority, {COUNT} FROM sc GROUP BY majority)", *EVAL)
on_planted("e4_by_dominant_attack", lambda l, r: U.confusion(judged(l, r).filter("dominant_attack IS NOT NULL"), "dominant_attack"), f"SELECT dominant_attack, {CONF} FROM (SELECT dominant_attack, {COUNT} FROM sc WHERE dominant_attack IS NOT NULL GROUP BY dominant_attack)", *EVAL)
on_planted("e5_agent_outcomes", lambda l, r: U.agent_outcomes(judged(l, r)), "SELECT agent, count(*) FILTER (is_true) AS tp, count(*) FILTER (NOT is_true) AS fp FROM (SELECT unnest(agents) AS agent, is_true FROM sc WHERE is_attack) GROUP BY agent", *EVAL)
_LABEL = "CASE p.threat " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.THREAT_LABELS.items()) + " ELSE p.threat END"
on_planted(
    "e6_agent_by_threat", lambda l, r: (lambda logs: U.agent_threats(found(logs, r), A.category_shares(logs)))(l),
    f"""SELECT agent, threat, {CONF.replace(", " + _RATE('fp', 'fp + tn') + " AS fpr", "")} FROM (SELECT agent, threat, {COUNT} FROM (SELECT p.agent, p.threat, f.fired AND f.threat = p.threat AS is_attack, coalesce(share >= 0.05, FALSE) AS is_true FROM (SELECT DISTINCT agent, threat FROM fn WHERE fired AND threat <> 'NONE') p
 JOIN fn f USING (agent) LEFT JOIN (SELECT batch_id, attack_category, n / sum(n) OVER (PARTITION BY batch_id)::DOUBLE AS share FROM cats) c ON c.batch_id = f.batch_id AND c.attack_category = {_LABEL}) GROUP BY ALL)""", *VERDICT,
)
on_planted("e7_per_record", lambda l, r: (lambda logs: U.confusion(logs.select("batch_id", (F.col("attack_category") != "Benign").alias("is_true")).join(U.fuse(found(logs, r)).select("batch_id", "is_attack"), "batch_id")))(l), f"SELECT {CONF} FROM (SELECT {COUNT} FROM (SELECT attack_category <> 'Benign' AS is_true, is_attack FROM logs JOIN vd USING (batch_id)))", *VERDICT)
on_planted("e8_rescore", lambda l, r: U.confusion(judged(l, r, 0.2, True)), f"SELECT {CONF} FROM (SELECT {COUNT} FROM (SELECT is_attack, attack_ratio >= 0.2 AS is_true FROM sc))", *EVAL)
_SUBSETS = ", ".join(f"('{'+'.join(c)}', '{a}')" for k in range(1, 7) for c in combinations(D.RULES, k) for a in c)
on_planted(
    "e10_subset_ablation", lambda l, r: (lambda logs: U.subset_ablation(found(logs, r), A.truth(logs), tuple(D.RULES)))(l),
    f"""SELECT *, row_number() OVER (ORDER BY f1 DESC, subset) AS place FROM (SELECT subset, {CONF} FROM (SELECT subset, {COUNT} FROM (SELECT subset, CASE WHEN n = 0 THEN FALSE WHEN n = 1 THEN best >= 0.8 ELSE round(ws / ww, 9) >= 0.6 END AS is_attack, attack_ratio > 0.05 AS is_true
 FROM (SELECT subset, batch_id, sum({_WT} * score) FILTER (fired) AS ws, sum({_WT}) FILTER (fired) AS ww, count(*) FILTER (fired) AS n, max(score) FILTER (fired) AS best FROM fn JOIN (VALUES {_SUBSETS}) s(subset, agent) USING (agent) GROUP BY ALL) JOIN a17 USING (batch_id)) GROUP BY subset))""", *VERDICT,
)
_P = "SELECT confidence, t, f, sum(t) OVER (ORDER BY confidence DESC)::BIGINT AS tp, sum(f) OVER (ORDER BY confidence DESC)::BIGINT AS fp, sum(t) OVER () AS p, sum(f) OVER () AS n FROM (SELECT confidence, count(*) FILTER (is_true) AS t, count(*) FILTER (NOT is_true) AS f FROM sc GROUP BY confidence)"
on_planted("e11_curve", lambda l, r: U.curve(judged(l, r)), f"SELECT confidence, tp, fp, {_RATE('tp', 'p')} AS tpr, {_RATE('fp', 'n')} AS fpr, {_RATE('tp', 'tp + fp')} AS precision FROM ({_P})", *EVAL)
on_planted("e11_timeline", lambda l, r: U.timeline(judged(l, r)), "SELECT batch_id, CASE WHEN is_attack THEN CASE WHEN is_true THEN 'TP' ELSE 'FP' END WHEN is_true THEN 'FN' ELSE 'TN' END AS outcome, confidence FROM sc", *EVAL)
on_planted("e12_pure_benign_fpr", lambda l, r: judged(l, r).filter("attack_ratio = 0").agg(F.count("*").alias("batches"), F.count(F.when(F.col("is_attack"), 1)).alias("fp")), "SELECT count(*) AS batches, count(*) FILTER (is_attack) AS fp FROM sc WHERE attack_ratio = 0", *EVAL)
on_planted("p19_threat_label", lambda l, r: judged(l, r).select("batch_id", S.threat_label(F.col("predicted")).alias("label")), "SELECT batch_id, CASE predicted " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.THREAT_LABELS.items()) + " ELSE predicted END AS label FROM sc", *EVAL)


def ablation_modes(logs: DataFrame, ranges: DataFrame, stacked: bool = True) -> DataFrame:
    """Rules alone (cold-start thresholds, A), adaptive thresholds (B), and the stacker on top (C); features are computed once."""
    ctx = context(logs, ranges)
    cold = ctx.withColumns({name: F.lit(value) for name, value in _COLD.items()})
    f = saved(D.findings(ctx))
    adaptive = saved(U.fuse(f))
    modes = {"A": U.fuse(D.findings(cold)), "B": adaptive} | ({"C": M.stacker(f, adaptive, numbers(logs), tuple(U.WEIGHTS))} if stacked else {})
    parts = [v.select(F.lit(mode).alias("mode"), "batch_id", "is_attack") for mode, v in modes.items()]
    return U.confusion(reduce(DataFrame.unionByName, parts).join(A.truth(logs).select("batch_id", (F.col("attack_ratio") > 0).alias("is_true")), "batch_id"), "mode")


_COLD = {"thr_dominant": 0.90, "thr_rate": 450.0, "thr_latency": 6500.0, "thr_entropy": 2.0, "thr_off_hours": 0.85, "thr_periodic": 2.0}
on_planted("e9_ablation_modes", lambda l, r: ablation_modes(l, r))
#: The expressions from the context to the verdict once more, under other names, on thresholds that never adapt.
_AGAIN = tuple(re.sub(r"\b(ctx|vol|tmp|aut|pay|seq|gpl|fr|fn|cf|cp|cn|rs|vd)\b", r"\1_cold", text) for text in (*Q.EACH, Q.RAW, Q.FINDINGS, CF, CP, CN, RS, VD))
COLD = "ctx_cold AS (SELECT * REPLACE (" + ", ".join(f"{value}::DOUBLE AS {name}" for name, value in _COLD.items()) + ") FROM ctx)"
on_planted(
    "e9_rules_and_adaptive", lambda l, r: ablation_modes(l, r, stacked=False),
    f"SELECT mode, {CONF} FROM (SELECT mode, {COUNT} FROM (SELECT mode, is_attack, attack_ratio > 0 AS is_true FROM (SELECT 'A' AS mode, batch_id, is_attack FROM vd_cold UNION ALL SELECT 'B', batch_id, is_attack FROM vd) JOIN a17 USING (batch_id)) GROUP BY mode)", *VERDICT, COLD, *_AGAIN,
)

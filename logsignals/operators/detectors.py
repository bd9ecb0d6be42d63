"""Detectors: rules over one row of features per batch, each a finding (score and type).

Rules are SQL expressions that any engine evaluates alike. A detector of one's own is a function from the feature table to
(batch_id, agent, score, threat); `findings` unites them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsignals.config import BENIGN_RATE_PORTS, SEQUENCE_WARMUP, WARMUP
from logsignals.functions.scalar import port
from logsignals.operators.baselines import gap_tests, history
from logsignals.tables import saved

_SLOW1 = "(saturation >= 0.5 AND pair_count >= 40 AND avg_latency > thr_latency AND pair_port IN (80, 8080, 8000))"
_SLOW2 = "(slow_count >= 100 AND slow_saturation >= 0.5 AND slow_cap_ratio >= 0.5)"
_GUARD = f"(pair_port IN ({', '.join(map(str, BENIGN_RATE_PORTS))}) AND top_count <= 0.9 * total)"
_SMALL = "(unique_ips BETWEEN 2 AND 50 AND dominant_ratio >= 0.25 AND dominant_ratio < thr_dominant AND top_count >= thr_rate)"
_SPREAD = "(unique_ips > 5 AND dominant_ratio < thr_dominant)"
_FLOOD = f"({_SPREAD} AND top_count >= 25 AND unique_ips <= 50 AND dominant_ratio >= 0.25)"
_SINGLE = "(top_count >= thr_rate AND dominant_ratio >= thr_dominant)"
_LATENT = f"({_SINGLE} AND unique_ips <= 2 AND avg_latency > thr_latency AND dominant_ratio <= 0.9)"
_SPIKE = "CASE WHEN dominant_ratio >= 0.5 AND spike_z >= 0.55 * 6 THEN least(1.0, spike_z / 6.0) ELSE 0.0 END"
_DDOS = "greatest(0.7, least(1.0, 0.65 + 0.4 * top_count / total))"
_HARD = "(max_entropy >= 6.0 AND entropy_distinct >= 100)"
_KNOWN = f"(batch_no >= {WARMUP} AND entropy_stable)"
_ADAPT = f"({_KNOWN} AND max_entropy >= thr_entropy AND entropy_distinct >= 5)"
_UNUSUAL = "CASE WHEN entropy_z > 2.0 THEN least(0.55, entropy_z / 5.0) ELSE 0.0 END"
_SWEEP = "CASE WHEN scan_signature THEN 0.8 ELSE 0.0 END"
_HITS = "CASE WHEN hits >= 3 THEN 0.6 ELSE 0.0 END"
_SENT = f"(dispatched >= {SEQUENCE_WARMUP} AND most_transitions >= 4)"

#: agent: [(condition, score, threat)], the first that holds counts; a score is the largest of all that speaks for it.
RULES: dict[str, list[tuple[str, str, str]]] = {
    "volume": [  # D1 to D8, D10; without enough evidence (D34) a score is 0.3 at most
        (f"batch_no < {WARMUP}", f"least(0.3, {_SPIKE})", "NONE"),
        (f"{_SLOW1} OR {_SLOW2}", f"greatest(least(1.0, 0.6 + 0.4 * saturation), {_SPIKE})", "DOS"),
        (_GUARD, f"least(0.3, {_SPIKE})", "NONE"),
        (f"{_SMALL} OR {_FLOOD}", f"greatest({_DDOS}, {_SPIKE})", "DDOS"),
        (f"{_SPREAD} OR {_LATENT}", f"least(0.3, {_SPIKE})", "NONE"),
        (_SINGLE, f"greatest(0.82, {_SPIKE})", "DOS"),
        (f"{_SPIKE} > 0 AND unique_ips > 5", _SPIKE, "DDOS"),
        (f"{_SPIKE} > 0", _SPIKE, "DOS"),
    ],
    "temporal": [  # D11 to D15
        ("span_ms < 200", "0.0", "NONE"),
        (
            "periodic_ips >= 1 OR off_hours_ratio > thr_off_hours OR off_hours_ratio > 0.85",
            "greatest(CASE WHEN periodic_ips >= thr_periodic THEN 0.9 * bot_conf WHEN periodic_ips >= 1 THEN 0.6 * bot_conf ELSE 0.0 END, CASE WHEN periodic_ips >= thr_periodic AND ks_p < 0.05 THEN 0.7 ELSE 0.0 END,"
            " CASE WHEN periodic_ips >= greatest(1.0, thr_periodic - 1) AND cusum_peak >= 4 THEN 0.72 ELSE 0.0 END, CASE WHEN off_hours_ratio > 0.85 THEN 0.6 ELSE 0.0 END)",
            "BOT_ACTIVITY",
        ),
    ],
    "auth": [  # D17 to D20: one score, and a type by what is most specific
        ("failures = 0", "0.0", "NONE"),
        ("stuffing_ips > 0", "SCORE", "CREDENTIAL_STUFFING"),
        ("top_failures >= 10", "SCORE", "BRUTE_FORCE"),
        ("failing_ips > 0", "SCORE", "NONE"),
    ],
    "payload": [  # D21 to D26: a scan has precedence over injections; without either or a known distribution nothing is said
        (f"{_HARD} AND any_port", f"greatest(0.7, {_SWEEP})", "PORT_SCAN"),
        (_HARD, f"greatest(0.7, {_SWEEP})", "ENUMERATION"),
        (f"{_ADAPT} AND any_port", f"greatest({_SWEEP}, {_UNUSUAL}, {_HITS})", "PORT_SCAN"),
        (_ADAPT, f"greatest({_SWEEP}, {_UNUSUAL}, {_HITS})", "ENUMERATION"),
        ("hits >= 3", f"greatest(least(0.95, 0.6 + 0.1 * families), {_UNUSUAL})", "WEB_ATTACK"),
        (_KNOWN, _UNUSUAL, "NONE"),
    ],
    "sequence": [(f"{_SENT} AND sequential_ips > 0", "1.0", "SEQUENCE_ABUSE")],  # D27
    "geo": [  # D28 to D32 (D33 is by session)
        ("resolved_ips < 0.1 * unique_ips AND NOT tor_listed", "0.0", "NONE"),
        (
            "tor_listed OR top_foreign_share >= 0.40 OR (home_known AND foreign_share >= 0.20 AND foreign_countries >= 3) OR (keys >= 10 AND countries >= 5 AND diversity >= 0.10)",
            "greatest(CASE WHEN tor_listed THEN 0.75 ELSE 0.0 END, CASE WHEN top_foreign_share >= 0.40 THEN 0.8 ELSE 0.0 END, CASE WHEN home_known AND foreign_share >= 0.20 AND foreign_countries >= 3 THEN round(least(0.5 + 0.4 * foreign_share, 0.85), 2) ELSE 0.0 END,"
            " CASE WHEN keys >= 10 AND countries >= 5 AND diversity >= 0.10 THEN round(least(0.55 + 0.6 * diversity, 0.80), 2) ELSE 0.0 END)",
            "GEO_ANOMALY",
        ),
    ],
}
_AUTH = (
    "greatest(CASE WHEN stuffing_ips > 0 THEN 0.8 ELSE 0.0 END, CASE WHEN top_failures >= 60 THEN greatest(0.8, least(1.0, top_failures / 75.0)) ELSE 0.0 END,"
    " CASE WHEN streak >= 10 THEN least(1.0, streak / 25.0 + 0.4) ELSE 0.0 END, CASE WHEN failing_ips > 0 THEN 0.6 ELSE 0.0 END)"
)
RULES["auth"] = [(on, _AUTH if score == "SCORE" else score, threat) for on, score, threat in RULES["auth"]]
FIRES = {"volume": 0.55, "temporal": 0.60, "auth": 0.45, "payload": 0.60, "sequence": 0.60, "geo": 0.50}


def case_sql(agent: str, what: str) -> str:
    """CASE over an agent's rules: its score, or its threat."""
    whens = " ".join(f"WHEN {on} THEN {score if what == 'score' else repr(threat)}" for on, score, threat in RULES[agent])
    return f"CASE {whens} ELSE {'0.0' if what == 'score' else repr('NONE')} END"


def with_context(features: DataFrame, geo: DataFrame, home_known: bool = False) -> DataFrame:
    """Features with thresholds, counters, the busiest pair's port, the test of their gaps and the countries of clients."""
    known = saved(history(features.drop("gap_list"), (F.col("endpoints") >= 3) | F.col("known_bad")))
    gaps = features.select("batch_id", "gap_list").join(known.select("tenant", "batch_id", "batch_no"), "batch_id")
    tests = gap_tests(gaps.select("tenant", "batch_id", "batch_no", F.inline("gap_list")))
    placed = geo.select("batch_id", F.col("keys").alias("resolved_ips"), "keys", "countries", "foreign_share", "top_foreign_share", "foreign_countries", "diversity", "tor_listed")
    out = known.withColumn("pair_port", F.coalesce(port(F.col("pair_endpoint")), F.lit(0)))
    out = out.join(tests, "batch_id", "left").join(placed, "batch_id", "left").withColumn("home_known", F.lit(home_known)).fillna(1.0, ["ks_p"])
    return out.fillna(0, ["resolved_ips", "keys", "countries", "foreign_share", "top_foreign_share", "foreign_countries", "diversity"]).fillna(False, ["tor_listed"])


def detect(features: DataFrame, agent: str) -> DataFrame:
    """(batch_id, agent, score, threat, fired) by an agent's rules."""
    out = features.select("batch_id", F.lit(agent).alias("agent"), F.round(F.expr(case_sql(agent, "score")).cast("double"), 3).alias("score"), F.expr(case_sql(agent, "threat")).alias("threat"))
    return out.withColumn("fired", F.col("score") >= FIRES[agent])


def findings(features: DataFrame, agents: tuple[str, ...] = tuple(RULES), more: tuple[Callable[[DataFrame], DataFrame], ...] = (), suppress: bool = True) -> DataFrame:
    """Findings of all agents; volume's DoS explains regular gaps, so temporal is silent then (D16, unless suppress is off)."""
    parts = [detect(features, a) for a in agents] + [f(features) for f in more]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not suppress:
        return out
    dos = out.filter("agent = 'volume' AND fired AND threat IN ('DOS', 'DDOS')").select("batch_id", F.lit(True).alias("dos"))
    held = F.coalesce("dos", F.lit(False)) & (F.col("agent") == "temporal")
    return out.join(dos, "batch_id", "left").withColumn("fired", F.col("fired") & ~held).drop("dos")


def geo_features(geo: DataFrame, home: str | None = None, listed: DataFrame | None = None, once: bool = False) -> DataFrame:
    """A14 to A16 from (batch_id, key, country): coverage, countries, foreign share, diversity; a key without a country is unresolved. A column n says for how many records a row stands. listed(key) are TOR or VPN exits (K6).

    once: geo has n and a key stands once in its batch, so that keys need no grouping."""
    g = geo if once else geo.groupBy("batch_id", "key", "country").agg((F.sum("n") if "n" in geo.columns else F.count("*")).alias("n"))
    c = g.filter("country IS NOT NULL").groupBy("batch_id", "country").agg(F.sum("n").alias("n"))
    foreign = (F.col("country") != home) if home else F.lit(True)
    out = c.groupBy("batch_id").agg(
        F.sum("n").alias("resolved"), F.count("*").alias("countries"), (F.coalesce(F.sum(F.when(foreign, F.col("n"))), F.lit(0)) / F.sum("n")).alias("foreign_share"),
        (F.coalesce(F.max(F.when(foreign, F.col("n"))), F.lit(0)) / F.sum("n")).alias("top_foreign_share"), F.count(F.when(foreign, 1)).alias("foreign_countries"),
    )
    places = F.when(F.col("country").isNotNull(), 1).otherwise(0)
    each = g.select("batch_id", "key", places.alias("places")) if once else g.groupBy("batch_id", "key").agg(F.count("country").alias("places"))
    keys = each.groupBy("batch_id").agg(F.count("key").alias("all_keys"), F.count(F.when(F.col("places") > 0, F.col("key"))).alias("keys"))
    out = keys.join(out, "batch_id", "left").fillna(0, ["resolved", "countries", "foreign_share", "top_foreign_share", "foreign_countries"])
    out = out.withColumns({"coverage": F.col("keys") / F.col("all_keys"), "diversity": F.coalesce(F.try_divide("countries", "keys"), F.lit(0.0))})
    if listed is None:
        return out.withColumn("tor_listed", F.lit(False))
    hit = g.join(F.broadcast(listed.select("key")), "key", "left_semi").select("batch_id").distinct().withColumn("tor_listed", F.lit(True))  # the list is a rule table
    return out.join(hit, "batch_id", "left").fillna(False, ["tor_listed"])


def ip_flags(clients: DataFrame, known: DataFrame) -> DataFrame:
    """K6: datacenter, vpn, tor and asn of each client, with defaults for those that known(ip, ...) hasn't."""
    j = clients.select("ip").distinct().join(known, "ip", "left")
    return j.select("ip", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("datacenter", "vpn", "tor")), F.coalesce("asn", F.lit("UNKNOWN")).alias("asn"))


def boosted(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """volume's score is at least twice the depth of an outlier's: of a batch whose iso_score is within the lowest share of its forest's own batches. scores(batch_id, iso_score, cut)."""
    j = findings.join(scores.filter(F.col("iso_score") <= F.col("cut")).select("batch_id", "iso_score"), "batch_id", "left")
    up = F.when((F.col("agent") == "volume") & F.col("iso_score").isNotNull(), F.round(F.greatest("score", F.least(F.lit(1.0), -2 * F.col("iso_score"))), 3)).otherwise(F.col("score"))
    fired = F.when(F.col("agent") == "volume", up >= FIRES["volume"]).otherwise(F.col("fired"))
    threat = F.when((F.col("agent") == "volume") & fired & (F.col("threat") == "NONE"), F.lit("DOS")).otherwise(F.col("threat"))
    return j.select("batch_id", "agent", up.alias("score"), threat.alias("threat"), fired.alias("fired"))

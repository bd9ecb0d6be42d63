"""Fusion of findings into one verdict per batch, evaluation against truth, and reputation of clients."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsignals.config import AGENTS, BLOCK
from logsignals.functions.scalar import THREAT_LABELS, explanation, owasp

#: Pairs of threats that together mean a third (fixed values): needed, meant, boost, least score of each.
COMPOUND = (
    ("DOS", "BOT_ACTIVITY", "SCRAPING", 0.08, 0.70),
    ("DDOS", "BOT_ACTIVITY", "DDOS", 0.10, 0.65),
    ("CREDENTIAL_STUFFING", "BOT_ACTIVITY", "CREDENTIAL_STUFFING", 0.10, 0.65),
    ("BRUTE_FORCE", "DOS", "BRUTE_FORCE", 0.08, 0.70),
    ("PORT_SCAN", "DOS", "PORT_SCAN", 0.10, 0.70),
)
#: Weights while nothing is learnt (fixed values).
WEIGHTS = {"volume": 1.0, "temporal": 0.9, "auth": 1.0, "payload": 0.9, "sequence": 0.85, "geo": 0.80}
#: Threats that come with others, and the agents whose domain they are (fixed values).
RELATED = (("CREDENTIAL_STUFFING", "BOT_ACTIVITY"), ("BOT_ACTIVITY", "DOS"), ("BOT_ACTIVITY", "SCRAPING"), ("SCRAPING", "BOT_ACTIVITY"), ("SCRAPING", "DOS"))
DOMAINS = (("volume", "DOS"), ("volume", "DDOS"), ("volume", "SCRAPING"), ("temporal", "BOT_ACTIVITY"), ("temporal", "SCRAPING"), ("auth", "BRUTE_FORCE"), ("auth", "CREDENTIAL_STUFFING"), ("payload", "PORT_SCAN"), ("payload", "WEB_ATTACK"), ("sequence", "SEQUENCE_ABUSE"), ("geo", "GEO_ANOMALY"))


def _values(rows: tuple, names: str) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f" AS t({names})"


def triage(observed: DataFrame) -> DataFrame:
    """which agents a batch is sent."""
    bad = F.coalesce("known_bad", F.lit(False))
    return observed.select(
        "batch_id", F.lit(True).alias("volume"), F.lit(True).alias("geo"), (bad | (F.col("auth_errors") > 0)).alias("auth"), (bad | (F.col("span_ms") > 200)).alias("temporal"),
        (bad | (F.col("endpoints") >= 5)).alias("payload"), (bad | (F.col("endpoints") >= 3)).alias("sequence"),
    )


def evidence(findings: DataFrame) -> DataFrame:
    """a row for each finding that fired."""
    return findings.filter("fired").select("batch_id", "agent", F.concat_ws(":", F.lower("threat"), "agent").alias("key"), F.col("score").alias("confidence"))


def compound_signals(findings: DataFrame) -> DataFrame:
    """rules whose both threats stand with enough score; the last sets the type, the largest boost counts."""
    rules = findings.sparkSession.sql("SELECT * FROM " + _values(tuple((i, *r) for i, r in enumerate(COMPOUND)), "at, one, two, meant, boost, least"))
    conf = findings.filter("fired").groupBy("batch_id", "threat").agg(F.max("score").alias("score"))
    a = conf.join(F.broadcast(rules), F.col("threat") == F.col("one")).select("batch_id", "at", "threat", "two", "meant", "boost", "least", F.col("score").alias("s1"))  # five rules
    b = conf.select("batch_id", F.col("threat").alias("two"), F.col("score").alias("s2"))
    held = a.join(b, ["batch_id", "two"]).filter((F.col("s1") >= F.col("least")) & (F.col("s2") >= F.col("least")))
    told = F.concat_ws(" + ", "threat", "two")
    return held.groupBy("batch_id").agg(
        F.max_by("meant", "at").alias("compound_threat"), F.max("boost").cast("double").alias("boost"), F.count("*").alias("signals"), F.transform(F.sort_array(F.collect_list(F.struct("at", told.alias("told")))), lambda x: x["told"]).alias("compound")
    )


def conflicts(findings: DataFrame) -> DataFrame:
    """a silent agent of low confidence with some score is raised to 0.45 of a related threat that stands high; the first by the order of agents counts."""
    spark = findings.sparkSession
    related = spark.sql("SELECT d.agent, r.high, min(r.related) AS related FROM (SELECT * FROM " + _values(RELATED, "high, related") + ") r JOIN (SELECT * FROM " + _values(DOMAINS, "agent, threat") + ") d ON d.threat = r.related GROUP BY d.agent, r.high")
    high = findings.filter("fired AND score >= 0.75").select("batch_id", F.col("threat").alias("high"), F.col("score").alias("high_score"), _order("agent").alias("at"))
    raised = findings.filter("NOT fired AND score >= 0.10 AND score < 0.45").join(F.broadcast(related), "agent").join(high, ["batch_id", "high"])  # few rules
    return raised.groupBy("batch_id", "agent").agg(F.min_by("related", F.struct("at", "high")).alias("raised_threat"), F.round(0.45 * F.min_by("high_score", F.struct("at", "high")), 3).alias("raised_score"))


def resolved(findings: DataFrame) -> DataFrame:
    """Findings after F4: raised agents have fired with the raised threat and score."""
    j = findings.join(conflicts(findings), ["batch_id", "agent"], "left")
    up = F.col("raised_score").isNotNull()
    return j.select("batch_id", "agent", F.coalesce("raised_score", "score").alias("score"), F.coalesce("raised_threat", "threat").alias("threat"), (F.col("fired") | up).alias("fired"))


def _order(agent: str):
    return F.array_position(F.array(*(F.lit(a) for a in AGENTS)), F.col(agent))


def _weight(agent="agent"):
    return F.create_map(*(F.lit(x) for p in WEIGHTS.items() for x in p))[F.col(agent)]


def fuse(findings: DataFrame, multi: float = 0.60, single: float = 0.80) -> DataFrame:
    """Conflicts are resolved (F4), then weighted mean and boost, thresholds for one agent and for more, and the type."""
    f = resolved(findings).withColumn("w", _weight())
    order = _order("agent")
    fused = f.groupBy("batch_id").agg(
        F.sum(F.when(F.col("fired"), F.col("w") * F.col("score"))).alias("ws"), F.sum(F.when(F.col("fired"), F.col("w"))).alias("ww"), F.count(F.when(F.col("fired"), 1)).alias("n_agents"),
        F.max(F.when(F.col("fired"), F.col("score"))).alias("best"), F.max_by(F.when(F.col("fired"), F.col("threat")), F.when(F.col("fired"), F.struct(F.col("score"), -order))).alias("own_threat"),
        F.sort_array(F.collect_list(F.when(F.col("fired"), F.col("agent")))).alias("agents"),
    )
    j = fused.join(compound_signals(findings), "batch_id", "left")
    conf = F.coalesce(F.least(F.lit(1.0), F.col("ws") / F.col("ww") + F.coalesce("boost", F.lit(0.0))), F.lit(0.0))
    threat = F.coalesce("compound_threat", "own_threat", F.lit("NONE"))
    j = j.withColumns({"fused": conf, "threat": threat})
    attack = F.when(F.col("n_agents") == 0, False).when(F.col("n_agents") == 1, F.col("best") >= single).otherwise(F.col("fused") >= multi) & (F.col("threat") != "NONE")
    out = j.withColumn("is_attack", attack).select("batch_id", "is_attack", F.when(F.col("is_attack"), F.col("threat")).otherwise("NONE").alias("threat"), F.round("fused", 3).alias("confidence"), "n_agents", "agents", F.coalesce("signals", F.lit(0)).alias("signals"), F.coalesce("compound", F.array().cast("array<string>")).alias("compound"), "boost")
    return out


def explained(verdicts: DataFrame, findings: DataFrame, plan: DataFrame) -> DataFrame:
    """P22 on verdicts: the head, compound signals, the agents that were sent the batch (triage), and what each fired agent found."""
    sent = plan.select("batch_id", F.filter(F.array(*(F.when(F.col(a), F.lit(a)) for a in AGENTS)), lambda x: x.isNotNull()).alias("sent"))
    line = F.concat_ws(" ", "agent", "threat", F.col("score").cast("string"))
    told = resolved(findings).filter("fired").groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct(_order("agent").alias("at"), line.alias("line")))).alias("told"))
    j = verdicts.join(sent, "batch_id").join(told, "batch_id", "left").withColumn("told", F.coalesce(F.transform("told", lambda x: x["line"]), F.array().cast("array<string>")))
    return j.withColumn("explanation", explanation(F.col("is_attack"), F.col("threat"), F.col("confidence"), F.col("sent"), F.col("compound"), F.col("told"))).drop("sent", "told")


def read_evidence(rows: DataFrame, key: str | None = None, agent: str | None = None, least: float = 0.0, latest: bool = False) -> DataFrame:
    """reads of evidence by part of a key, agent and least confidence; with `latest` the last batch's row of each key."""
    out = rows.filter(F.col("confidence") >= least)
    out = out.filter(F.col("key").contains(key)) if key else out
    out = out.filter(F.col("agent") == agent) if agent else out
    return out.groupBy("key").agg(F.max("batch_id").alias("batch_id"), F.max_by("confidence", "batch_id").alias("confidence")) if latest else out


class RollingWeights:
    """What each agent's last `last` fired findings came to, and the weights that follow: their share of attacks once there are `least`, the fixed weight until then (and where all were)."""

    def __init__(self, past: dict[str, Iterable[bool]] | None = None, last: int = 100, least: int = 20) -> None:
        self.past, self.least = {a: deque((past or {}).get(a, ()), maxlen=last) for a in WEIGHTS}, least

    def verdict(self, fired: list[tuple[str, float]]) -> tuple[float, bool]:
        """(fused, is_attack) of the (agent, score) that fired for a batch, which then count for the next."""
        total = mass = 0.0
        for agent, score in fired:
            p = self.past[agent]
            w = sum(p) / len(p) if len(p) >= self.least else 1.0
            w = WEIGHTS[agent] if w == 1.0 else w
            total, mass = total + w * score, mass + w
        fused = total / mass if mass else 0.0
        attack = bool(mass) and fused >= 0.6
        for agent, _ in fired:
            self.past[agent].append(attack)
        return round(fused, 3), attack


def learned_fusion(findings: DataFrame, tenants: DataFrame, last: int = 100, least: int = 20) -> DataFrame:
    """F6 with B10: an agent's weight is its precision over its last fired batches, by verdicts so far; `least` of them are needed. tenants(tenant, batch_id).

    The one recursive step. A tenant's findings come in order, sorted on disk where they are many, and the fold holds no more than `last` flags of each agent from one
    batch to the next, whatever their number.
    """
    rows = resolved(findings).join(tenants.select("tenant", "batch_id"), "batch_id").select("tenant", "batch_id", "agent", "score", "fired")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        weights, group = RollingWeights(), []

        for frame in frames:
            out = []
            for tenant, batch, agent, score, fired in frame.itertuples(index=False):
                if held != (tenant, batch):
                    if held is not None:
                        out.append((*held, *weights.verdict(group)))
                    if held is None or held[0] != tenant:
                        weights = RollingWeights(None, last, least)
                    held, group = (tenant, batch), []
                if fired:
                    group.append((agent, score))
            yield pd.DataFrame(out, columns=["tenant", "batch_id", "fused", "is_attack"])
        if held is not None:
            yield pd.DataFrame([(*held, *weights.verdict(group))], columns=["tenant", "batch_id", "fused", "is_attack"])

    return rows.repartition("tenant").sortWithinPartitions("tenant", "batch_id", "agent").mapInPandas(fold, "tenant string, batch_id long, fused double, is_attack boolean")


def scores(verdicts: DataFrame, truth: DataFrame, threshold: float = 0.05, inclusive: bool = False) -> DataFrame:
    """Verdict and truth side by side."""
    hit = F.col("attack_ratio") >= threshold if inclusive else F.col("attack_ratio") > threshold
    return verdicts.select("batch_id", "is_attack", F.col("threat").alias("predicted"), "confidence", "agents").join(truth.withColumn("is_true", hit), "batch_id")


def confusion(scored: DataFrame, *by: str) -> DataFrame:
    """Counts and rates, 0 where undefined."""
    p, t = F.col("is_attack"), F.col("is_true")
    c = scored.groupBy(*by).agg(F.count(F.when(p & t, 1)).alias("tp"), F.count(F.when(p & ~t, 1)).alias("fp"), F.count(F.when(~p & t, 1)).alias("fn"), F.count(F.when(~p & ~t, 1)).alias("tn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    precision, recall = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        *by, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        rate(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"), rate(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
    )


def agent_outcomes(scored: DataFrame) -> DataFrame:
    """E5: true and false positives to which each agent contributed."""
    return scored.filter("is_attack").select(F.explode("agents").alias("agent"), "is_true").groupBy("agent").agg(F.count(F.when(F.col("is_true"), 1)).alias("tp"), F.count(F.when(~F.col("is_true"), 1)).alias("fp"))


def agent_threats(findings: DataFrame, shares: DataFrame, least: float = 0.05) -> DataFrame:
    """For every (agent, threat) that ever fired: did it fire where the category has `least` of the batch? Counts and rates over all batches of that agent."""
    f = findings.filter("fired AND threat <> 'NONE'").select("batch_id", "agent", "threat")
    ever = f.select("agent", "threat").distinct()
    label = F.coalesce(F.create_map(*(F.lit(x) for p in THREAT_LABELS.items() for x in p))[F.col("threat")], F.col("threat"))
    every = findings.select("batch_id", "agent").distinct().join(F.broadcast(ever), "agent").withColumn("category", label)  # agents times threats at most
    present = shares.filter(F.col("share") >= least).select("batch_id", F.col("attack_category").alias("category"), F.lit(True).alias("is_true"))
    j = every.join(f.withColumn("is_attack", F.lit(True)), ["batch_id", "agent", "threat"], "left").join(present, ["batch_id", "category"], "left")
    return confusion(j.fillna(False, ["is_attack", "is_true"]), "agent", "threat").drop("fpr")


def subset_ablation(findings: DataFrame, truth: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """All subsets of agents at once, by a broadcast table of 2^n - 1 subsets, ranked by F1."""
    spark = findings.sparkSession
    subsets = [("+".join(c), a) for k in range(1, len(agents) + 1) for c in combinations(agents, k) for a in c]
    table = spark.createDataFrame(subsets, "subset string, agent string")
    f = findings.join(F.broadcast(table), "agent").withColumn("w", _weight())  # at most 2^6 * 6 rows
    v = f.groupBy("subset", "batch_id").agg(F.sum(F.when(F.col("fired"), F.col("w") * F.col("score"))).alias("ws"), F.sum(F.when(F.col("fired"), F.col("w"))).alias("ww"), F.count(F.when(F.col("fired"), 1)).alias("n"), F.max(F.when(F.col("fired"), F.col("score"))).alias("best"))
    attack = F.when(F.col("n") == 0, False).when(F.col("n") == 1, F.col("best") >= 0.8).otherwise(F.round(F.col("ws") / F.col("ww"), 9) >= 0.6)
    c = confusion(v.withColumn("is_attack", attack).join(truth.select("batch_id", (F.col("attack_ratio") > 0.05).alias("is_true")), "batch_id"), "subset")
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "subset")).cast("long"))  # a row a subset


def curve(scored: DataFrame) -> DataFrame:
    """ROC and precision-recall points by confidence, which has 1001 values at most."""
    c = scored.groupBy("confidence").agg(F.count(F.when(F.col("is_true"), 1)).alias("t"), F.count(F.when(~F.col("is_true"), 1)).alias("f"))
    w = Window.orderBy(F.desc("confidence"))
    p = c.select("confidence", F.sum("t").over(w).alias("tp"), F.sum("f").over(w).alias("fp"), F.sum("t").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("p"), F.sum("f").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0)), 4)
    return p.select("confidence", "tp", "fp", rate("tp", F.col("p")).alias("tpr"), rate("fp", F.col("n")).alias("fpr"), rate("tp", F.col("tp") + F.col("fp")).alias("precision"))


def timeline(scored: DataFrame) -> DataFrame:
    """What each batch's verdict was worth."""
    p, t = F.col("is_attack"), F.col("is_true")
    return scored.select("batch_id", F.when(p & t, "TP").when(p, "FP").when(t, "FN").otherwise("TN").alias("outcome"), "confidence")


#: Verdicts up to which they are broadcast (some 50 MB); beyond, a shuffled join.
BROADCAST_VERDICTS = 1_000_000


def ip_history(logs: DataFrame, verdicts: DataFrame, last: int = 50, size: int = BLOCK, once: bool = False) -> DataFrame:
    """K2: every client of a batch gets its verdict; the last ones stay. Each block of batches hands on its own last ones, so a client of all batches is dealt out. once: logs has each client of a batch once."""
    clients, own = logs.select("batch_id", "ip"), verdicts.select("batch_id", "is_attack", "confidence")
    own = F.broadcast(own) if once and own.count() <= BROADCAST_VERDICTS else own
    h = (clients if once else clients.distinct()).join(own, "batch_id").withColumn("_block", F.floor(F.col("batch_id") / size))
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch_id"))).cast("long")
    few = h.withColumn("rn", nth("ip", "_block")).filter(F.col("rn") <= last)
    return few.withColumn("rn", nth("ip")).filter(F.col("rn") <= last).drop("_block")


def reputation(history: DataFrame, bad: DataFrame) -> DataFrame:
    """K1, K3, K4: decayed mean of attack confidences, repeat offenders, and the known-bad list."""
    w = F.pow(F.lit(0.95), F.col("rn") - 1)
    r = history.groupBy("ip").agg((F.sum(F.when(F.col("is_attack"), F.col("confidence") * w)) / F.sum(F.when(F.col("is_attack"), w))).alias("prior"), F.count(F.when(F.col("is_attack"), 1)).alias("attacks"), F.max_by("confidence", "batch_id").alias("current"))
    listed = bad.select("ip").distinct().withColumn("known_bad", F.lit(True))
    j = r.join(listed, "ip", "left").withColumn("known_bad", F.coalesce("known_bad", F.lit(False)))
    prior = F.coalesce("prior", F.when(F.col("known_bad"), 0.85).otherwise(0.0))
    repeat = (F.col("attacks") >= 3) & (F.col("current") >= 0.70)
    return j.select("ip", "known_bad", F.round(prior, 6).alias("prior"), "attacks", repeat.alias("repeat_offender"), F.when(repeat, F.least(F.lit(1.0), 0.5 + 0.1 * F.col("attacks"))).otherwise(0.0).alias("repeat_confidence"))


def reputation_answer(answers: DataFrame, history: DataFrame, asked: DataFrame) -> DataFrame:
    """K5: for asked(ip, endpoint): known_bad, prior confidence, a summary of the history in words, and the OWASP context of the endpoint."""
    seen = history.groupBy("ip").agg(F.count("*").alias("total"))
    j = asked.join(answers.select("ip", "known_bad", "prior", "attacks"), "ip", "left").join(seen, "ip", "left").fillna(False, ["known_bad"]).fillna(0, ["prior", "attacks", "total"])
    parts = (
        F.when(F.col("known_bad"), F.lit("IP is in known-bad seed list.")),
        F.when(F.col("total") > 0, F.concat(F.lit("Seen in "), F.col("total").cast("string"), F.lit(" prior batch(es); "), F.col("attacks").cast("string"), F.lit(" flagged as attack."))),
        F.when(F.col("attacks") >= 3, F.lit("Repeat offender \u2014 escalated pre-emptive confidence.")),
    )
    summary = F.when(~F.col("known_bad") & (F.col("total") == 0), "No prior activity on record.").otherwise(F.concat_ws(" ", *parts))
    return j.select("ip", "endpoint", "known_bad", F.round("prior", 3).alias("prior_confidence"), summary.alias("history_summary"), owasp(F.col("endpoint")).alias("owasp_context"))

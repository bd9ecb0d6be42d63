"""Models as of their time: a batch is scored by the newest model that was fitted on earlier batches of its tenant alone.

Every `every` batches of a tenant a version is fitted on the last `back` batches before it. A version's rows, those it learns from and those it scores, meet in one group of bounded size, so
versions are fitted side by side, none passes through the driver, and what comes later changes nothing. A batch takes part in back / every versions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 8


def by_version(batches: DataFrame, columns: list[str], every: int, back: int, least: int, fit: Callable[[pd.DataFrame, pd.DataFrame, int], pd.DataFrame], schema: str) -> DataFrame:
    """batches(tenant, batch_id, batch_no, columns): for each version with `least` batches before it fit(learnt from, scored, seed) -> batch_id and the columns of schema."""
    at = F.col("batch_no") - 1
    own = F.floor(at / every)
    last = batches.groupBy("tenant").agg(F.floor((F.max("batch_no") - 1) / every).alias("_last"))
    rows = batches.select("tenant", "batch_id", "batch_no", *columns).join(last, "tenant")
    rows = rows.withColumn("version", F.explode(F.sequence(own, F.least(F.col("_last"), F.floor((at + back) / every))))).withColumn("scored", F.col("version") == own).drop("_last")
    rows = rows.filter(F.col("version") * every >= least)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch_no")
        seed = zlib.crc32(f"{frame['tenant'].iloc[0]}:{frame['version'].iloc[0]}".encode())
        return fit(frame[~frame["scored"]], frame[frame["scored"]], seed)

    return rows.groupBy("tenant", "version").applyInPandas(run, f"batch_id long, {schema}")


class Forest:
    """Isolation trees, all grown at once, level by level: node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, x: np.ndarray, trees: int, sample: int, seed: int) -> None:
        rng, n = np.random.default_rng(seed), min(sample, len(x))
        nodes = (2 << DEPTH) - 1
        drawn = x[np.argsort(rng.random((trees, len(x))), 1)[:, :n]].reshape(-1, x.shape[1])
        tree = np.repeat(np.arange(trees), n)
        at = tree * nodes
        self.feature, self.cut, self.path = np.full(trees * nodes, -1), np.zeros(trees * nodes), np.zeros(trees * nodes)
        self.trees, self.nodes, self.scale = trees, nodes, float(_average_path(np.array([max(n, 2)]))[0])
        for depth in range(DEPTH + 1):
            held = np.bincount(at, minlength=trees * nodes)
            low, high = np.full((x.shape[1], trees * nodes), np.inf), np.full((x.shape[1], trees * nodes), -np.inf)
            for c in range(x.shape[1]):
                np.minimum.at(low[c], at, drawn[:, c])
                np.maximum.at(high[c], at, drawn[:, c])
            wide = (high > low) & (depth < DEPTH)
            inner = wide.any(0)
            chance = np.where(wide, rng.random(wide.shape), -1.0)
            level = np.arange((1 << depth) - 1, (2 << depth) - 1)
            here = (np.arange(trees)[:, None] * nodes + level).ravel()
            self.path[here] = depth + _average_path(held[here])
            split = here[inner[here]]
            self.feature[split] = chance[:, split].argmax(0)
            f = self.feature[split]
            self.cut[split] = low[f, split] + rng.random(len(split)) * (high[f, split] - low[f, split])
            on = self.feature[at] >= 0
            at, drawn = at[on], drawn[on]
            if not len(at):
                break
            at = at + at % nodes + 1 + (drawn[np.arange(len(at)), self.feature[at]] >= self.cut[at])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """-2^(-mean path / expected path): lower where a row stands apart."""
        at = np.arange(self.trees)[:, None] * self.nodes + np.zeros(len(x), int)
        rows = np.broadcast_to(np.arange(len(x)), at.shape)
        while (inner := self.feature[at] >= 0).any():
            k, f = at[inner], self.feature[at[inner]]
            at[inner] = k + k % self.nodes + 1 + (x[rows[inner], f] >= self.cut[k])
        return -(2 ** (-self.path[at].mean(0) / self.scale)) if len(x) else np.empty(0)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Expected depth of a node that is left with n rows."""
    m = np.maximum(n, 3).astype(float)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))


def isolation(batches: DataFrame, columns: list[str], every: int = 10, back: int = 500, least: int = 30, trees: int = 100, sample: int = 256, share: float = 0.05, seed: int = 42) -> DataFrame:
    """ML1: (batch_id, iso_score, cut): the score by the forest of the batch's version, and the score below which the `share` of that forest's own batches lie. None before `least` batches."""

    def fit(learnt: pd.DataFrame, scored: pd.DataFrame, version: int) -> pd.DataFrame:
        x = learnt[columns].to_numpy(float)
        forest = Forest(x, trees, sample, seed + version)
        return pd.DataFrame({"batch_id": scored["batch_id"], "iso_score": forest.scores(scored[columns].to_numpy(float)), "cut": float(np.quantile(forest.scores(x), share))})

    return by_version(batches, columns, every, back, least, fit, "iso_score double, cut double")


def boosted_trees(x: np.ndarray, y: np.ndarray, of: np.ndarray, rounds: int = 50, depth: int = 3, rate: float = 0.1, bins: int = 32) -> np.ndarray:
    """Probabilities of the rows `of` by trees boosted on (x, y): logistic loss, second-order gains over binned features, leaves shrunk by 1."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = lambda m: np.stack([np.searchsorted(q, c, "right") for q, c in zip(cuts, m.T)], 1)
    own, other, d = binned(x), binned(of), x.shape[1]
    start = np.log(y.mean() / (1 - y.mean()))
    margin, result = np.full(len(x), start), np.full(len(of), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at, to = np.zeros(len(x), int), np.zeros(len(of), int)
        for level in range(depth):
            n = 1 << level
            key = ((at[:, None] * d + np.arange(d)) * bins + own).ravel()
            left = np.stack([np.bincount(key, np.repeat(w, d), n * d * bins).reshape(n, d, bins) for w in (g, h)]).cumsum(3)
            whole = left[:, :, :, -1:]
            gain = lambda s: s[0] ** 2 / (s[1] + 1)
            best = (gain(left) + gain(whole - left) - gain(whole)).reshape(n, -1)
            feature, cut = np.divmod(best.argmax(1), bins)
            cut = np.where(best.max(1) > 1e-9, cut, bins)  # all to the left
            at, to = 2 * at + (own[np.arange(len(x)), feature[at]] > cut[at]), 2 * to + (other[np.arange(len(of)), feature[to]] > cut[to])
        leaf = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + 1)
        margin, result = margin + leaf[at], result + leaf[to]
    return 1 / (1 + np.exp(-result))


def stacker(findings: DataFrame, verdicts: DataFrame, numbers: DataFrame, agents: tuple[str, ...], every: int = 25, back: int = 2000, least: int = 50) -> DataFrame:
    """ML2 and F7: trees on agents' scores learn the rule verdicts of earlier batches and blend into later ones: 0.4 of the fused confidence and 0.6 of theirs, but not over a rule verdict with an agent at 0.8.

    A version needs `least` earlier batches, both verdicts among them, attacks in at least a twentieth; where there is none the rule verdict holds. numbers(tenant, batch_id, batch_no).
    """
    wide = findings.groupBy("batch_id").agg(
        *(F.coalesce(F.max(F.when(F.col("agent") == a, F.col("score"))), F.lit(0.0)).alias(a) for a in agents), F.sum(F.col("fired").cast("double")).alias("n_active"), F.coalesce(F.max(F.when(F.col("fired"), F.col("score"))), F.lit(0.0)).alias("primary")
    )
    columns = [*agents, "n_active", "boost"]
    x = wide.join(verdicts.select("batch_id", "is_attack", "confidence", "threat", F.coalesce("boost", F.lit(0.0)).alias("boost")), "batch_id").join(numbers, "batch_id").withColumn("label", F.col("is_attack").cast("double"))

    def fit(learnt: pd.DataFrame, scored: pd.DataFrame, version: int) -> pd.DataFrame:
        y = learnt["label"].to_numpy(float)
        if not 0.05 * len(y) <= y.sum() < len(y):
            return pd.DataFrame({"batch_id": scored["batch_id"][:0], "p": np.empty(0)})
        return pd.DataFrame({"batch_id": scored["batch_id"], "p": boosted_trees(learnt[columns].to_numpy(float), y, scored[columns].to_numpy(float))})

    p = by_version(x, [*columns, "label"], every, back, least, fit, "p double")
    j = x.join(p, "batch_id", "left")
    fixed = F.col("p").isNull() | (F.col("is_attack") & (F.col("primary") >= 0.8))
    blended = F.when(fixed, F.col("confidence")).otherwise(0.4 * F.col("confidence") + 0.6 * F.col("p"))
    return j.select("batch_id", F.when(fixed, F.col("is_attack")).otherwise((blended >= 0.6) & (F.col("threat") != "NONE")).alias("is_attack"), F.round(blended, 3).alias("confidence"), F.round("p", 6).alias("p"))

"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts with a confirmed toxic label; the unlabelled ones are drawn from all training texts, whatever is known of them.
A linear classifier on the presence of selected words and character n-grams is trained by numpy on the risk
pi * R+(P) + max(0, R-(U) - pi * R-(P)), where pi, the share of toxic texts, comes from all training labels; where the
second term falls below zero its gradient is turned, which keeps the estimate from overfitting. Features are
selected by how far their share of positives departs from that of unlabelled texts.

Fitting uses a bounded sample (POSITIVES and UNLABELLED texts, by hash of the id); scoring covers every whole text.
Labels are learnt only where crc32(id) mod 5 is not 0; labels, lang, source and id are no inputs of a score.
Null and empty texts have no features and get the bias alone; equal texts get equal scores; without positives
every score is 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsignals.llm.textual import by_text, saved, table, words_of

#: Bounds of the sample to fit on, and numbers of features and steps.
POSITIVES, UNLABELLED, FEATURES, STEPS = 3_000, 6_000, 600, 400
GRAMS = (4, 5, 6, 7)
_TRIM = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
#: Words whose features a worker remembers (memory only).
REMEMBERED = 500_000
#: Bytes of a word that is remembered.
LONGEST = 128


def grams(word: bytes) -> Iterator[bytes]:
    """A word without outer signs, and its character n-grams with borders, whatever its length."""
    w = word.strip(_TRIM)
    if w:
        t = f"<{w.decode()}>"
        yield t.encode()
        for n in GRAMS:
            for i in range(len(t) - n + 1):
                yield t[i : i + n].encode()


def _shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that hold each feature, among positives and others; those of one text alone can't be selected and are left."""
    counts = (Counter(), Counter())
    for frame in frames:
        for text, positive in zip(frame["text"], frame["positive"]):
            held: set[bytes] = set()
            for w in set(words_of(text)):
                held.update(grams(w))
            counts[int(positive)].update(held)
    names = list(counts[0].keys() | counts[1].keys())
    yield pd.DataFrame({"gram": names, "u": [counts[0][g] for g in names], "p": [counts[1][g] for g in names]})


class Scorer:
    """Features of a text under a selection, with words remembered."""

    def __init__(self, selected: list[bytes]) -> None:
        self.at = {g: i for i, g in enumerate(selected)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def features(self, text: str | None) -> np.ndarray:
        words = set(words_of(text))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        held: set[int] = set()
        for w in words:
            f = self.known.get(w)
            if f is None:
                f = tuple({self.at[g] for g in grams(w) if g in self.at})
                if len(w) <= LONGEST:
                    self.known[w] = f
            held.update(f)
        return np.array(sorted(held), np.int64)


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (the bias last) of a linear classifier that minimises the non-negative PU risk with logistic loss, by Adam."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    xp, xu = x[positive], x[~positive]
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    w[-1] = np.log(prior / (1 - prior))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = xp @ w, xu @ w
        rest = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        up = -prior * (xp * (1 - sig(zp))[:, None]).mean(0)
        down = (xu * sig(zu)[:, None]).mean(0) - prior * (xp * sig(zp)[:, None]).mean(0)
        g = (up + down if rest >= 0 else -down) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray] | None:
    """(selected features, weights) from the training rows; None without positives. Only bounded results reach the driver."""
    trained = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.filter(trained & F.col("toxic").isNotNull())
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not prior:
        return None
    positives = known.filter("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).withColumn("positive", F.lit(True))
    others = docs.filter(trained).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(UNLABELLED).withColumn("positive", F.lit(False))
    chosen = saved(positives.union(others))  # POSITIVES + UNLABELLED ids at most
    sample = saved(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(16, F.xxhash64("doc_id")))
    n = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    shares = sample.mapInPandas(_shares, "gram binary, u long, p long").groupBy("gram").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).filter("u + p >= 8")
    a, b = (F.col("p") + 1) / (n[True] + 2), (F.col("u") + 1) / (n[False] + 2)
    z = (a - b) / F.sqrt(a * (1 - a) / n[True] + b * (1 - b) / n[False])
    best = shares.orderBy(F.abs(z).desc(), "gram").limit(FEATURES).select("gram")
    selected = sorted(bytes(r["gram"]) for r in best.collect())

    def held():
        scorer = Scorer(selected)
        return lambda texts: pd.DataFrame({"at": [scorer.features(t) for t in texts]})

    rows = by_text(sample.select("doc_id", "positive", "text"), held, "at array<long>").orderBy("doc_id").toPandas()
    x = np.zeros((len(rows), len(selected)))
    for i, at in enumerate(rows["at"]):
        x[i, np.asarray(at, int)] = 1
    positive = rows["positive"].to_numpy(bool)
    w = fit_nnpu(x, positive, float(prior))
    z = x @ w[:-1] + w[-1]
    w[-1] -= cut(z[positive], z[~positive], float(prior))
    return selected, w


def cut(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The threshold of the best F-score as positives and unlabelled texts show it: 2 * pi * recall / (pi + share of all that is taken)."""
    at = np.unique(zp)
    recall = 1 - np.searchsorted(np.sort(zp), at) / len(zp)
    taken = 1 - np.searchsorted(np.sort(zu), at) / len(zu)
    best = int(np.argmax(2 * prior * recall / (prior + np.maximum(taken, prior * recall))))
    below = zu[zu < at[best]]
    return float(at[best] if not len(below) else (at[best] + below.max()) / 2)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def make():
        scorer = Scorer(model.value[0]) if model.value else None

        def score(texts: list[str | None]) -> pd.DataFrame:
            out = np.zeros(len(texts))
            if scorer:
                w = model.value[1]
                z = np.array([w[scorer.features(t)].sum() for t in texts]) + w[-1]
                out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return pd.DataFrame({"score": out, "predicted": (out >= 0.5).astype(np.int32)})

        return score

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return by_text(docs.select("doc_id", held_out, "text"), make, "score double, predicted int")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

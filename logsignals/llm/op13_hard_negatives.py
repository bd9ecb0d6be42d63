"""Hard negatives by threshold joins of anchors with all rows, in blocks.

Anchors and rows are dealt into blocks, and every block of anchors meets every block of rows in one task. There the rows' inverted index is built: dimensions
in the order of their weight, CHUNK at a time, each with a posting list of the rows that have it. A row's last dimensions are left out
where the norms of what follows show that they alone can't reach the threshold of any anchor. Scores are accumulated along the posting lists; a pair goes on only while its
partial score and the product of the remaining norms can reach the anchor's threshold, and is finished exactly. Thresholds start
near the top of a window (a range of scores of which the first k rows are wanted) and are lowered until the window has filled or its floor is reached.

Each join has two passes: over one block in SAMPLE first, whose k-th score is then a floor for all other blocks; so a window gets some k times SAMPLE candidates, not k from every block.
All numbers are whole, and exact: sums are in doubles while they stay under 2^53, else in 64-bit integers.

Rows with a null label, vector or component, with a component that isn't finite, or with a squared norm above 2^56 (whose scores don't fit) take no part. Vectors of different length are
compared over the shorter one's. Null ids are no anchors and come last among ties; rows with equal ids are rows each, and an anchor excludes itself alone. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsignals.llm.textual import saved, table

#: Rows and anchors of a block at most (about), dimensions of a posting list, pairs of a tile, and the share of blocks of the first pass.
ROWS, ANCHORS, CHUNK, TILE, SAMPLE = 65_536, 16_384, 8, 4_000_000, 16
MOST = float(1 << 56)
LOWEST, HIGHEST = -(1 << 62), 1 << 62
_FOUND = pa.schema([("a", pa.int64()), ("p", pa.int64()), ("r", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND = "a long, p long, r long, vec_id long, score long"


class Index:
    """Rows of a block, by posting lists of chunks of dimensions."""

    def __init__(self, y: np.ndarray) -> None:
        self.order = np.argsort(-(y.astype(float) ** 2).sum(0), kind="stable")
        self.y = y[:, self.order]
        self.norms = self._suffixes(self.y)

    @staticmethod
    def _suffixes(m: np.ndarray) -> np.ndarray:
        """Norms of what follows 0, 1, 2 ... chunks, a little too large rather than too small."""
        squares = np.add.reduceat(m.astype(float) ** 2, np.arange(0, m.shape[1], CHUNK), 1) if m.shape[1] else np.zeros((len(m), 0))
        return np.concatenate([np.sqrt(np.cumsum(squares[:, ::-1], 1)[:, ::-1]) * (1 + 1e-9), np.zeros((len(m), 1))], 1)

    def reach(self, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i, row, score) with x[i] . row >= least[i]."""
        x = x[:, self.order]
        norms, chunks = self._suffixes(x), self.norms.shape[1] - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            free = np.where(least[:, None] > 0, least[:, None] / norms, -1.0).min(0)  # a row whose suffix has a smaller norm can't reach any threshold by it
        depth = (self.norms >= free).sum(1).clip(0, chunks) if len(x) else np.zeros(len(self.y), int)
        rows = np.argsort(-depth, kind="stable")
        depth, y, rest = depth[rows], self.y[rows], self.norms[rows]
        listed = np.searchsorted(-depth, -np.arange(chunks), "left")  # rows in each posting list
        found = []
        step = max(1, TILE // max(1, len(y)))
        for low in range(0, len(x), step):
            own, t = x[low : low + step], least[low : low + step]
            partial = np.zeros((len(own), len(y)), x.dtype)
            for c in range(chunks):
                part = slice(CHUNK * c, CHUNK * (c + 1))
                partial[:, : listed[c]] += own[:, part] @ y[: listed[c], part].T
            open_ = partial + norms[low : low + step][:, depth] * rest[np.arange(len(y)), depth] >= t[:, None]
            i, r = np.nonzero(open_)
            score = partial[i, r]
            for c in range(chunks):
                part, more = slice(CHUNK * c, CHUNK * (c + 1)), depth[r] <= c
                score[more] += (own[i[more], part] * y[r[more], part]).sum(1)
                at = np.maximum(depth[r], c + 1)
                on = score + norms[low + i, at] * rest[r, at] >= t[i]
                i, r, score = i[on], r[on], score[on]
            found.append((low + i, rows[r], score))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0, x.dtype))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of `width` numbers, with zeros behind shorter ones."""
    column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def windows_of(anchors: pa.Table, rows: pa.Table, same: bool) -> pa.Table:
    """The first k rows of each window of each anchor, among rows of its label (same) or of others, as far as they reach the window's floor."""
    n = {"a": [], "p": [], "r": [], "vec_id": [], "score": []}
    if len(anchors) and len(rows):
        label, other = np.asarray(anchors["label"]), np.asarray(rows["label"])
        width = max(int(np.asarray(t["v"].combine_chunks().value_lengths()).max()) for t in (anchors, rows))
        x, y = _matrix(anchors["v"], width), _matrix(rows["v"], width)
        if float(np.sqrt((x.astype(float) ** 2).sum(1).max() * (y.astype(float) ** 2).sum(1).max())) < 2**52:
            x, y = x.astype(float), y.astype(float)
        for one in np.unique(label):
            use, among = np.flatnonzero(label == one), np.flatnonzero((other == one) == same)
            if len(among):
                _fill(anchors.take(pa.array(use)), x[use], rows.take(pa.array(among)), y[among], n)
    return pa.table({c: pa.array(v, pa.int64()) for c, v in n.items()}, _FOUND)


def _fill(anchors: pa.Table, x: np.ndarray, rows: pa.Table, y: np.ndarray, out: dict[str, list]) -> None:
    index, ids, numbers = Index(y), rows["vec_id"].to_pylist(), np.asarray(rows["r"])
    known = np.array([i is not None for i in ids])
    place = np.empty(len(ids), np.int64)  # of ties
    place[np.lexsort([numbers, np.array([i or 0 for i in ids]), ~known])] = np.arange(len(ids))
    own = np.asarray(anchors["a"])
    reach = np.sqrt((x.astype(float) ** 2).sum(1)) * index.norms[:, 0].max() + 1
    # windows still open: anchor, positive, least and highest score, rows wanted, and the threshold
    open_ = [(i, w["p"], max(w["low"], -int(reach[i])), min(w["high"], int(reach[i])), w["k"]) for i, ws in enumerate(anchors["windows"].to_pylist()) for w in ws]
    open_ = [w for w in open_ if w[2] <= w[3]]
    span = 8
    while open_:
        t = np.full(len(x), np.inf)
        for i, _, low, high, _ in open_:
            t[i] = min(t[i], low if span == 1 else high - (high - low) // span)
        use = np.flatnonzero(np.isfinite(t))
        i, r, score = index.reach(x[use], t[use])
        i = use[i]
        other = numbers[r] != own[i]
        i, r, score = i[other], r[other], score[other].astype(np.int64)
        order = np.lexsort([place[r], -score, i])
        i, r, score = i[order], r[order], score[order]
        bounds = np.searchsorted(i, np.arange(len(x) + 1))
        still = []
        for w in open_:
            a, p, low, high, k = w
            s = score[bounds[a] : bounds[a + 1]]
            first = int(np.searchsorted(-s, -high))
            last = min(int(np.searchsorted(-s, -max(low, int(t[a])), "right")), first + k)
            if last - first < k and t[a] > low:
                still.append(w)
                continue
            for j in range(bounds[a] + first, bounds[a] + last):
                out["a"].append(int(own[a]))
                out["p"].append(p)
                out["r"].append(int(numbers[r[j]]))
                out["vec_id"].append(ids[r[j]])
                out["score"].append(int(score[j]))
        open_, span = still, span // 2


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window, with their rank."""
    w = Window.partitionBy("a", "p").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "r")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def joined(asked: DataFrame, rows: DataFrame, same: bool, k: int) -> DataFrame:
    """asked(a, label, v, windows), saved rows(r, vec_id, label, v) -> the first k rows of every window: a, p, r, vec_id, score, rank."""
    spark = rows.sparkSession
    n, m = rows.count(), asked.count()
    dealt = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, groups = max(-(-n // ROWS), min(dealt, -(-n // 32)), 1), max(-(-m // ANCHORS), 1)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    sides = rows.withColumns({"block": F.pmod(F.xxhash64("r"), F.lit(blocks)).cast("int")})
    meet = lambda left, right: left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(lambda a, b: windows_of(a, b, same), FOUND)

    def over(ask: DataFrame, of: Column) -> DataFrame:
        left = ask.withColumns({"group": F.pmod(F.xxhash64("a"), F.lit(groups)).cast("int"), "block": every(blocks)}).filter(of).select(F.col("block").alias("block"), F.col("group").alias("group"), "a", "windows", F.col("label").alias("label"), F.col("v").alias("v"))
        return meet(left, sides.filter(of).withColumn("group", every(groups)))

    sampled = F.col("block") % SAMPLE == 0
    early = saved(_first(over(asked, sampled), k))
    full = early.filter(F.col("rank") == k).select("a", "p", F.col("score").alias("floor"))
    floors = full.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("p", "floor"))).alias("floors"))  # as many as an anchor has windows
    raised = asked.join(floors, "a", "left").withColumn("windows", F.transform("windows", lambda w: w.withField("low", F.greatest(w["low"], F.coalesce(F.try_element_at("floors", w["p"]), w["low"]))))).drop("floors")
    late = over(raised, ~sampled)
    return _first(early.select(*late.columns).unionByName(late), k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors(vec_id, label, v): v whole numbers. An anchor's positives are the first rows of its label by inner product; the negatives of each are the first rows of other labels whose score
    is between `low` and `high` hundredths of the positive's.
    """
    fits = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) <= MOST
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v")).filter(F.col("label").isNotNull() & fits & F.coalesce(~F.exists("v", lambda c: c.isNull()), F.lit(False)))
    rows = saved(rows.withColumn("r", F.monotonically_increasing_id()))
    asked = rows.filter(anchors).select(F.col("r").alias("a"), F.col("vec_id").alias("anchor_id"), "label", "v")
    window = lambda p, least, most, k: F.struct(p.cast("long").alias("p"), least.cast("long").alias("low"), most.cast("long").alias("high"), F.lit(k).alias("k"))
    pairs = saved(joined(asked.select("a", "label", "v", F.array(window(F.lit(-1), F.lit(LOWEST), F.lit(HIGHEST), positives)).alias("windows")), rows, True, positives).select("a", F.col("r").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    down = lambda x: f"(({x} - pmod({x}, 100L)) div 100)"  # hundredths, rounded down
    least, most = F.expr(f"-{down(f'-{low} * positive_score')}"), F.expr(down(f"{high} * positive_score"))
    wanted = pairs.groupBy("a").agg(F.collect_list(window(F.col("p"), least, most, negatives)).alias("windows"))
    found = joined(asked.select("a", "label", "v").join(wanted, "a"), rows, False, negatives)
    named = pairs.join(asked.select("a", "anchor_id"), "a")
    return found.join(named, ["a", "p"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def whole_numbers(vectors: DataFrame, scale: int = 256, vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, v: components times scale, rounded down; rows that take part only."""
    finite = lambda x: ~(F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.col("label").isNotNull() & F.col(vector_col).isNotNull()).filter(F.forall(vector_col, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))))
    return kept.select("vec_id", "label", F.transform(vector_col, lambda x: F.floor(scale * x.cast("double"))).alias("v"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS r, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

"""LM scoring by logistic context mixing of hashed bit predictors.

A text is its lower-cased words and one end. Every token is spelt as bits: a frequent word (and the end) by its path in a Huffman
tree of the DICTIONARY most frequent words, any other as an escape and then its bytes and a space, by paths in a tree of bytes. So
each bit is a decision at a node of a tree, and several predictors give its odds from hashed contexts: for words the node alone (word frequency), the
node after the previous word, and after the two before; for bytes the node after one and two bytes and after the whole word so far.
Their stretched predictions are mixed by weights learnt online, one set for each gate (how often the two longer contexts have
been met), and the mixture is refined by an adaptive map from its value and the gate to what followed there.

Texts are also cut into phrases where a word's hash says so (about PHRASE words). A phrase that the training texts hold elsewhere
is predicted as a whole by its frequency; the share of phrases that recur is the weight of that expert. A training text is scored
with itself left out once: each count is less by what the token, or the phrase, itself has added. So texts that occur twice stand apart.

1. Words are counted (a table in the shared folder): counts c, total N, distinct V; the dictionary has those above a count, found by a histogram.
2. Training texts are read once, online in steps of STEP tokens: predict, move each gate's weights by the mean gradient of its bits, count. Tasks' slots, of fixed size, are summed, and
   their weights averaged by what they have seen; the refining map stays as training leaves it.
3. Every text is scored where it lies; words outside the dictionary fetch c for the base score, phrases fetch their counts, both by a join.

Null texts are the end alone; long texts are scored whole; equal rows count and score each; a null id is in training;
other columns are ignored; an empty table gives no rows; without training words slots predict 1/2.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from logsignals.llm.textual import mixed, saved, table, words_of

#: Words with a path of their own, the bytes that such a word has at most, and words of a phrase on average.
DICTIONARY, LONGEST, PHRASE = 1 << 17, 64, 32
#: Contexts of each tree, slots of each context (memory of an executor), slots that travel together, gates, and cells of the refining map.
CONTEXTS, SLOTS, CHUNK, GATES, CELLS = 3, 1 << 20, 1 << 16, 16, 33
#: Text bytes of a training task, tasks at least, characters of texts that are read together, and tokens of a step.
TASK_BYTES, TASKS, GROUP, STEP = 256_000_000, 12, 1_000_000, 8_192
#: Distinct words that a task holds before it hands their counts on.
HELD = 250_000
#: Sums side by side of a gate, so that one addition needn't wait for the one before.
LANES = 8
RATE, PRIOR = 0.5, np.float32(0.4)
ESCAPE, END = 0, 1
_K1, _K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


class Tree:
    """Paths of symbols in a Huffman tree by their counts: (node, bit) from the root down."""

    def __init__(self, counts: np.ndarray) -> None:
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        leaves, made, parent, side = counts[order].tolist(), [], np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        i = j = 0
        for t in range(n - 1):  # the two lightest are the next leaf or the oldest node
            weight = 0
            for s in (0, 1):
                if j >= len(made) or (i < n and leaves[i] <= made[j]):
                    child, weight, i = order[i], weight + leaves[i], i + 1
                else:
                    child, weight, j = n + j, weight + made[j], j + 1
                parent[child], side[child] = t, s
            made.append(weight)
        at, steps = np.arange(n), []
        while (live := np.flatnonzero(at != 2 * n - 2)).size:
            steps.append((live, parent[at[live]], side[at[live]]))
            at[live] = n + parent[at[live]]
        self.length = np.zeros(n, np.int32)
        for live, _, _ in steps:
            self.length[live] += 1
        self.offset = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.node, self.bit = np.zeros(int(self.length.sum()), np.int32), np.zeros(int(self.length.sum()), np.uint8)
        for up, (live, node, bit) in enumerate(steps, 1):
            place = self.offset[live] + self.length[live] - up
            self.node[place], self.bit[place] = node, bit
        self.both = self.node << 1 | self.bit


class Words:
    """The dictionary with its tree, and texts as tokens under it."""

    def __init__(self, words: list[bytes], counts: np.ndarray, ends: int) -> None:
        self.at = {w: i for i, w in enumerate(words, 2)} | {b"": END}
        self.counts = np.concatenate([[0, ends], counts]).astype(np.float64)
        self.tree = Tree(np.concatenate([[max(1, int(counts.sum()) // 8), max(1, ends)], np.maximum(1, counts)]))
        self.hashes = np.array([0, xxh3_64_intdigest(b""), *map(xxh3_64_intdigest, words)], np.uint64)
        self.bytes = Tree(np.bincount(np.frombuffer(b" ".join([*words, b""]), np.uint8), minlength=256) * 16 + 1)

    def tokens(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, tokens of each text, symbol of each token, its hash); the end is an empty word."""
        every, sizes = [], []
        for t in texts:
            words = words_of(t)
            every += words
            every.append(b"")
            sizes.append(len(words) + 1)
        symbols = np.fromiter(map(self.at.get, every, repeat(ESCAPE)), np.int32, len(every))
        hashes = self.hashes.take(symbols)
        rare = np.flatnonzero(symbols == ESCAPE)
        hashes[rare] = np.fromiter((xxh3_64_intdigest(every[i]) for i in rare.tolist()), np.uint64, len(rare))
        return every, np.array(sizes), symbols, hashes


class Stream:
    """Mixed predictions for the bits of one tree; counts[context] has n0 and n1 of each slot side by side."""

    def __init__(self, tree: Tree, counts: np.ndarray | None = None, weights: np.ndarray | None = None, refined: np.ndarray | None = None) -> None:
        self.tree = tree
        self.counts = np.zeros((CONTEXTS, 2 * SLOTS), np.int32) if counts is None else counts
        self.weights = np.full((CONTEXTS, GATES), 0.3, np.float32) if weights is None else weights.astype(np.float32)
        self.seen = np.zeros(GATES * CELLS * 2)
        self.refined = refined
        self.tables: dict[bool, list[np.ndarray]] = {}

    def places(self, symbols: np.ndarray, contexts: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(bits of each symbol, bit, slot of each context); a context of None is the node alone."""
        size = self.tree.length.take(symbols)
        first = np.cumsum(size, dtype=np.int32) - size
        at = np.arange(int(size.sum()), dtype=np.int32) + np.repeat(self.tree.offset.take(symbols) - first, size)
        node = self.tree.both.take(at).view(np.uint32)
        bit = (node & np.uint32(1)).astype(np.int64)
        node >>= np.uint32(1)
        scaled, out = node * _K1, []
        for c in contexts:
            if c is None:
                slot = node & np.uint32(SLOTS - 1)
            else:
                slot = np.repeat(c, size)
                slot += scaled
                slot *= _K2
                slot >>= np.uint32(32 - SLOTS.bit_length() + 1)
            out.append(slot.astype(np.int64))
        return size, bit, out

    def learn(self, symbols: np.ndarray, contexts: list[np.ndarray | None]) -> None:
        """One online step: predict, move the weights of the gates, count."""
        _, bit, at = self.places(symbols, contexts)
        if not len(bit):
            return
        x, met = [], []
        for k in range(CONTEXTS):
            n = self.counts[k].view(np.int64).take(at[k])
            if k:
                met.append(_bucket((n >> 32) + (n & 0x7FFFFFFF)))
            odds = n.view(np.int32).astype(np.float32)
            odds += PRIOR
            odds = odds[1::2] / odds[::2]
            x.append(np.log(odds, out=odds))
        gate = ((met[0] << 2) | met[1]).astype(np.int64)
        z = self._mixed(gate, x)
        error = bit.astype(np.float32) - 1 / (1 + np.exp(-z))
        apart = gate * LANES + (np.arange(len(gate)) & (LANES - 1))
        mass = np.maximum(_by_gate(apart), 64)
        one = np.int64(1) << (bit << 5)  # n0 is the lower half of a slot, n1 the upper
        for k in range(CONTEXTS):
            self.weights[k] += (RATE * _by_gate(apart, error * x[k]) / mass).astype(np.float32)
            np.add.at(self.counts[k].view(np.int64), at[k], one)
        self.seen += np.bincount((gate * CELLS + _cell(z)) * 2 + bit, minlength=len(self.seen))

    def _mixed(self, gate: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
        z = self.weights[0].take(gate)
        z *= x[0]
        for k in range(1, CONTEXTS):
            own = self.weights[k].take(gate)
            own *= x[k]
            z += own
        return np.clip(z, -20, 20, out=z)

    def frozen(self) -> Stream:
        """With tables of what each (slot, bit) predicts, for training texts (the bit itself left out) and others; the two last bits of a number tell how often the slot was met."""
        for held_out in (False, True):
            self.tables[held_out] = []
            for k in range(CONTEXTS):
                n = self.counts[k].reshape(-1, 2).astype(np.float32)
                own = np.zeros((len(n), 2, 2), np.float32) + n[:, None, :]
                if not held_out:
                    own -= np.eye(2, dtype=np.float32)
                    np.maximum(own, 0, out=own)
                x = np.log((own[..., 1] + PRIOR) / (own[..., 0] + PRIOR)).ravel().view(np.uint32)
                self.tables[held_out].append(((x & ~np.uint32(3)) | _bucket(own.sum(2)).ravel().astype(np.uint32)).view(np.float32))
        del self.counts
        return self

    def logs(self, symbols: np.ndarray, contexts: list[np.ndarray | None], held_out: bool) -> np.ndarray:
        """ln p of each symbol."""
        size, bit, at = self.places(symbols, contexts)
        x = [self.tables[held_out][k].take((at[k] << 1) | bit) for k in range(CONTEXTS)]
        low = [v.view(np.uint32) & np.uint32(3) for v in x[1:]]
        gate = ((low[0] << np.uint32(2)) | low[1]).astype(np.int64)
        z = self._mixed(gate, x)
        p = 1 / (1 + np.exp(np.where(bit, -z, z)))
        if self.refined is not None:
            p = 0.6 * p + 0.4 * self.refined.take((gate * CELLS + _cell(z)) * 2 + bit)
        return np.add.reduceat(np.log(p), np.cumsum(size) - size) if len(size) else np.zeros(0)


def _by_gate(apart: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Sums by gate of what lies at gate * LANES + lane."""
    return np.bincount(apart, values, GATES * LANES).reshape(GATES, LANES).sum(1)


def _bucket(n: np.ndarray) -> np.ndarray:
    return (n > 0).view(np.uint8) + (n > 1).view(np.uint8) + (n > 4).view(np.uint8)


def _cell(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2 + CELLS // 2), 0, CELLS - 1).astype(np.int64)


def _spelt(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bytes of the words, each with a space after it, and their three contexts)."""
    flat = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    wide = flat.astype(np.uint64)
    one = np.where(place > 0, np.roll(wide, 1), np.uint64(0))
    two = one | np.where(place > 1, np.roll(wide, 2), np.uint64(0)) << np.uint64(8)
    sums = np.concatenate([np.zeros(1, np.uint64), mixed(wide + (place.astype(np.uint64) << np.uint64(8))).cumsum(dtype=np.uint64)])
    here = np.arange(len(flat))
    return flat.astype(np.int64), [_context(one, 1), _context(two, 2), _context(sums[here] - sums[here - place], 3)]


def _context(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(32)).astype(np.uint32)


def _before(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray | None]:
    """The contexts of tokens: none, the word before, the two before; texts begin where `first` is."""
    one = np.where(first, np.uint64(0), np.roll(hashes, 1))
    two = np.where(first, np.uint64(0), np.roll(one, 1))
    with np.errstate(over="ignore"):
        return [None, _context(one, 4), _context(one + mixed(two + np.uint64(7)), 5)]


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches with about GROUP characters."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > GROUP or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def _starts(sizes: np.ndarray, total: int) -> np.ndarray:
    first = np.zeros(total, bool)
    first[np.cumsum(sizes) - sizes] = True
    return first


def _planes(n: np.ndarray) -> bytes:
    """Numbers of four bytes, all first bytes before all second ones, which compresses well."""
    return n.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(b) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


_last: dict[str, object] = {}


def _once(key: str, make):
    """What a worker keeps for its next tasks."""
    if key not in _last:
        for old in [k for k in _last if k.split(":")[0] == key.split(":")[0]]:
            del _last[old]
        _last[key] = make()
    return _last[key]


class Model:
    """What every task needs to score: the broadcast dictionary, and the streams' counts, weights and maps."""

    def __init__(self, spark: SparkSession, words: list[bytes], counts: np.ndarray, ends: int) -> None:
        self.key = uuid.uuid4().hex
        self.dictionary = spark.sparkContext.broadcast((words, counts, ends))
        self.counts, self.weights, self.refined = None, [None, None], [None, None]

    def words(self) -> Words:
        return _once(f"words:{self.key}", lambda: Words(*self.dictionary.value))

    def new(self) -> list[Stream]:
        words = self.words()
        return [Stream(words.tree), Stream(words.bytes)]

    def streams(self) -> list[Stream]:
        def made() -> list[Stream]:
            words, held = self.words(), [np.concatenate([_from_planes(zlib.decompress(p)) for p in s]).reshape(CONTEXTS, -1) for s in self.counts.value]
            return [Stream(tree, n, w, r).frozen() for tree, n, w, r in zip((words.tree, words.bytes), held, self.weights, self.refined)]

        return _once(f"streams:{self.key}", made)


def fit(texts: DataFrame, model: Model, tasks: int) -> Model:
    """The model with counts, weights and maps from training texts. What reaches the driver is bounded: slots, weights and the maps."""

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        words, streams, total = model.words(), model.new(), 0
        for _, some in _groups(batches, 0):
            every, sizes, symbols, hashes = words.tokens(some)
            contexts = _before(hashes, _starts(sizes, len(symbols)))
            total += len(symbols)
            for at in range(0, len(symbols), STEP):
                step = slice(at, at + STEP)
                streams[0].learn(symbols[step], [c if c is None else c[step] for c in contexts])
                streams[1].learn(*_spelt([every[at + i] for i in np.flatnonzero(symbols[step] == ESCAPE).tolist()]))
        if total:
            for s, stream in enumerate(streams):
                for chunk, part in enumerate(stream.counts.reshape(-1, 2 * CHUNK)):
                    if part.any():
                        yield pa.RecordBatch.from_pandas(pd.DataFrame({"stream": [s], "chunk": [chunk], "n": [_planes(part)], "total": [0.0], "weights": [None], "seen": [None]}), SCHEMA)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"stream": [s], "chunk": [-1], "n": [None], "total": [float(total)], "weights": [stream.weights.ravel().tolist()], "seen": [stream.seen.tolist()]}), SCHEMA)

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["chunk"].iloc[0] >= 0:
            return frame[:1].assign(n=[_planes(sum(map(_from_planes, frame["n"])))])
        weights = np.average(np.stack(frame["weights"].tolist()), axis=0, weights=frame["total"])
        return frame[:1].assign(weights=[weights.tolist()], seen=[np.stack(frame["seen"].tolist()).sum(0).tolist()])

    schema = "stream long, chunk long, n binary, total double, weights array<double>, seen array<double>"
    parts = texts.select("text").coalesce(tasks).mapInArrow(learnt, schema).groupBy("stream", "chunk").applyInPandas(summed, schema)
    none = zlib.compress(_planes(np.zeros(2 * CHUNK, np.int32)), 1)
    counts = [[none] * (CONTEXTS * SLOTS // CHUNK) for _ in range(2)]
    for row in parts.toLocalIterator(prefetchPartitions=True):
        if row.chunk >= 0:
            counts[row.stream][row.chunk] = zlib.compress(row.n, 1)
        else:
            seen = np.array(row.seen).reshape(GATES, CELLS, 2)
            prior = 1 / (1 + np.exp(-(np.arange(CELLS) - CELLS // 2) / 2))
            model.weights[row.stream] = np.array(row.weights).reshape(CONTEXTS, GATES)
            model.refined[row.stream] = ((seen + 20 * np.stack([1 - prior, prior], 1)) / (seen.sum(2, keepdims=True) + 20)).ravel().astype(np.float32)
    model.counts = texts.sparkSession.sparkContext.broadcast(counts)
    return model


SCHEMA = pa.schema([("stream", pa.int64()), ("chunk", pa.int64()), ("n", pa.binary()), ("total", pa.float64()), ("weights", pa.list_(pa.float64())), ("seen", pa.list_(pa.float64()))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over text: words and how often they occur, those of some HELD distinct words at a time."""

    def rows(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > HELD:  # memory
                yield rows(counts)
                counts = Counter()
    if counts:
        yield rows(counts)


def dictionary(vocabulary: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """At most DICTIONARY words, those above a count that a histogram of counts by powers of 2^(1/8) tells."""
    short = vocabulary.filter(F.octet_length("word") <= LONGEST)
    bucket = F.floor(F.log2("c") * 8)
    histogram = sorted(((r.b, r.n) for r in short.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 8 * 64 rows
    least, room = None, DICTIONARY
    for b, n in histogram:
        if n > room:
            break
        least, room = b, room - n
    if least is None:
        return [], np.zeros(0, np.int64)
    top = short.filter(bucket >= least).orderBy(F.desc("c"), "word").toArrow()
    return [bytes(w) for w in top["word"].to_pylist()], top["c"].to_numpy().astype(np.int64)


PARTS = "mark long, doc_id long, held_out boolean, phrases array<struct<phrase:bigint,lp:double>>, words array<binary>, n long, known long, base double, bytes long"
NAMES = "mark doc_id held_out phrases words n known base bytes".split()


def _scored(model: Model, total: int, distinct: int):
    """For mapInArrow over (doc_id, mark, held_out, text): a row for each text, with its phrases and ln p of their tokens, and its words outside the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, streams = model.words(), model.streams()
        base_of = np.log10((words.counts + 0.1) / (total + 0.1 * (distinct + 1)))
        for batch, texts in _groups(batches, 3):
            every, sizes, symbols, hashes = words.tokens(texts)
            first = _starts(sizes, len(symbols))
            contexts, doc = _before(hashes, first), np.repeat(np.arange(len(sizes)), sizes)
            held_out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            logs = np.empty(len(symbols))
            for held in (False, True):
                own = np.flatnonzero(held_out[doc] == held)
                for at in range(0, len(own), STEP):
                    step = own[at : at + STEP]
                    log = streams[0].logs(symbols[step], [c if c is None else c[step] for c in contexts], held)
                    rare = np.flatnonzero(symbols[step] == ESCAPE)
                    if len(rare):
                        spelt = [every[i] for i in step[rare].tolist()]
                        ends = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)) + 1)
                        sums = np.concatenate([[0.0], np.cumsum(streams[1].logs(*_spelt(spelt), held))])[np.append(0, ends)]
                        log[rare] += np.diff(sums)
                    logs[step] = log
            starts = first | np.roll(((hashes & np.uint64(PHRASE - 1)) == 0) | (symbols == END), 1)
            at = np.flatnonzero(starts)
            with np.errstate(over="ignore"):
                place = np.arange(len(symbols)) - at[np.cumsum(starts) - 1]
                phrase = mixed(np.add.reduceat(mixed(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at)).view(np.int64)
            own, begin, rare = doc[at], np.flatnonzero(first), np.flatnonzero(symbols == ESCAPE)
            known, weight = (symbols != ESCAPE) & (words.counts[symbols] > 0), np.where(symbols == ESCAPE, 0.0, base_of[symbols])
            length = np.fromiter(map(len, every), np.int64, len(every)) + 1
            phrases = pa.StructArray.from_arrays([pa.array(phrase), pa.array(np.add.reduceat(logs, at))], ["phrase", "lp"])
            lists = _lists(own, phrases, len(sizes)), _lists(doc[rare], pa.array([every[i] for i in rare.tolist()], pa.binary()), len(sizes))
            numbers = sizes, np.add.reduceat(known.astype(np.int64), begin), np.add.reduceat(weight, begin), np.add.reduceat(length, begin)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), *lists, *map(pa.array, numbers)], NAMES)

    return run


def _lists(doc: np.ndarray, values: pa.Array, size: int) -> pa.Array:
    """A list for each of `size` texts, of the values whose doc it is."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.bincount(doc, minlength=size).cumsum()), pa.int32()), values)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), held_out.alias("held_out"), "text")
    train = docs.filter(~F.col("held_out"))
    vocabulary = saved(train.select("text").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    ends, size = train.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)) + ends, F.count("*") + int(ends > 0)).first()
    model = fit(train, Model(spark, *dictionary(vocabulary), ends), max(TASKS, -(-(size or 0) // TASK_BYTES)))

    parts = saved(docs.mapInArrow(_scored(model, total, distinct), PARTS))
    phrases = parts.select("mark", "held_out", F.explode("phrases").alias("x")).select("mark", "held_out", "x.phrase", "x.lp")
    seen = saved(phrases.filter(~F.col("held_out")).groupBy("phrase").agg(F.count("*").alias("seen")))
    again, every = seen.agg(F.coalesce(F.sum(F.when(F.col("seen") > 1, F.col("seen"))), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    share = (again + 1) / (every + 2)
    others = F.coalesce("seen", F.lit(0)) - F.when(F.col("held_out"), 0).otherwise(1)
    alone = F.col("lp") / np.log(10) + float(np.log10(1 - share))
    whole = F.log10(share * others / max(every, 1))
    log = F.when(others > 0, F.greatest(alone, whole) + F.log1p(F.pow(F.lit(10.0), -F.abs(alone - whole))) / np.log(10)).otherwise(alone)
    logs = phrases.join(seen, "phrase", "left").groupBy("mark").agg(F.sum(log).alias("score"))
    count = F.coalesce("c", F.lit(0))
    words = parts.select("mark", F.explode("words").alias("word")).join(vocabulary, "word", "left")
    rare = words.groupBy("mark").agg(F.count_if(count > 0).alias("known"), F.sum(F.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))).alias("base"))
    none, zero = F.lit(None), F.lit(0).cast("long")
    sums = parts.select("mark", "doc_id", "held_out", F.lit(0.0).alias("score"), "n", "known", "base", "bytes", F.lit(1).alias("last")).union(
        logs.select("mark", none.alias("doc_id"), none.alias("held_out"), "score", zero.alias("n"), zero.alias("known"), F.lit(0.0).alias("base"), zero.alias("bytes"), F.lit(0).alias("last"))
    ).union(rare.select("mark", none.alias("doc_id"), none.alias("held_out"), F.lit(0.0).alias("score"), zero.alias("n"), "known", "base", zero.alias("bytes"), F.lit(0).alias("last")))
    sums = sums.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("score", "n", "known", "base", "bytes", "last")))
    each = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))))  # equal rows have one mark
    whole = lambda c: (F.col(c) / F.col("last")).cast("long")
    score = F.col("score") / F.col("last")
    return each.select(
        "doc_id", "held_out", whole("n").alias("n_tokens"), whole("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") / F.col("last")).alias("base_score"), score.alias("score"),
        (-score / float(np.log10(2)) / whole("bytes")).alias("bits_per_byte"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))

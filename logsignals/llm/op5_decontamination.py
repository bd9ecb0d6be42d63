"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are partitioned by the size of their shingle sets, each band up to twice its least size. For each band,
documents are cut into windows of twice the band's upper size, half overlapping, so that an item lies whole in some window and
containment of t in it means a Jaccard similarity of about t / 2 or more. A window and an item meet if one of
PERMUTATIONS least hashes agrees. Windows without any item shingle (a Bloom filter of the items tells; it has no false
negatives) can't agree anywhere and are skipped. What meets is verified: the share of the item's distinct shingles
that stand in the document, by equality of 64-bit hashes.

Shingles are five lower-cased words; an item of fewer words has one, the whole; null or empty items match nothing, and null or
empty documents hold nothing. Long documents have more windows; repeated rows report each id once; rows with a null id
report null; other columns are ignored; with either table empty there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsignals.llm.textual import mixed, saved, shingles_of, table, windows_of, words_of

SIZE, SHARE, PERMUTATIONS = 5, 0.8, 48
#: Bits of the Bloom filter (2 MB) and its hashes.
BLOOM_BITS, BLOOM_HASHES = 1 << 24, 3
#: Keys of items up to which they are broadcast to the windows (some MB); beyond, a shuffled join.
BROADCAST_KEYS = 200_000

_SALTS = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))


def _band(n: int) -> int:
    """Band b holds items of 2^b to 2^(b+1) - 1 shingles."""
    return int(n).bit_length() - 1


def _least(hashes: np.ndarray, band: int) -> np.ndarray:
    """Keys of a set: the least of its hashes under each permutation, told apart by band and permutation."""
    with np.errstate(over="ignore"):
        return mixed(mixed(hashes[None, :] ^ _SALTS[:, None]).min(1) + _SALTS * np.uint64(band + 1))


def _item_rows(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame["item_id"], frame["text"]):
                h = shingles_of(words_of(text), size)
                if len(h):
                    rows.append((item, len(h), _band(len(h)), h.view(np.int64), _least(h, _band(len(h))).view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "n", "band", "items", "keys"])

    return run


def _bits(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.stack([mixed(h + _SALTS[i]) & np.uint64(BLOOM_BITS - 1) for i in range(BLOOM_HASHES)]).astype(np.int64)


def _bloom(items: DataFrame) -> bytes:
    """A Bloom filter of all items' shingles; parts are united bit by bit, so the driver gets it at a fixed size."""
    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(BLOOM_BITS, bool)
        for frame in frames:
            for h in frame["items"]:
                bits[_bits(np.asarray(h, np.int64).view(np.uint64)).ravel()] = True
        packed = np.packbits(bits).reshape(256, -1)
        rows = [(i, packed[i].tobytes()) for i in range(256) if packed[i].any()]
        yield pd.DataFrame(rows, columns=["block", "bits"])

    def united(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": frame["block"][:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in frame["bits"]]).tobytes()]})

    parts = items.select("items").mapInPandas(part, "block int, bits binary")
    blocks = {r["block"]: r["bits"] for r in parts.groupBy("block").applyInPandas(united, "block int, bits binary").toLocalIterator()}
    return b"".join(blocks.get(i, bytes(BLOOM_BITS // 8 // 256)) for i in range(256))


def _window_rows(size: int, bands: list[tuple[int, bool]], bloom):
    """For mapInArrow over (doc_id, mark, text): the shingles and keys of rows that may hold an item. Ids stay in Arrow, so that large ones and nulls pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bloom.value, np.uint8)).astype(bool)
        for batch in batches:
            row, hits, keys = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                for width in {min(size, len(words))} | ({w for w in range(1, size) if w <= len(words)} if bands[0][1] else set()):
                    h = windows_of(words, width)
                    at = np.flatnonzero(bits[_bits(h)].all(0))
                    if len(at):
                        row.append(i)
                        hits.append(np.unique(h[at]).view(np.int64))
                        keys.append(np.unique(_keys(h, at, bands, width < size)).view(np.int64))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "hits", "keys"])

    return run


def _keys(h: np.ndarray, at: np.ndarray, bands: list[tuple[int, bool]], short: bool) -> np.ndarray:
    """Keys of the windows that hold a shingle at one of the places `at`."""
    if short:  # a whole item of fewer words than a shingle: a set of one
        return np.concatenate([_least(h[i : i + 1], 0) for i in at])
    out = []
    for band, _ in bands:
        upper = 2 << band
        for k in np.unique(np.concatenate([at // upper, np.maximum(at // upper - 1, 0)])):
            out.append(_least(h[k * upper : (k + 2) * upper], band))
    return np.concatenate(out)


def contained_rows(docs: DataFrame, items: DataFrame, size: int = SIZE, share: float = SHARE) -> DataFrame:
    """(doc_id, mark, item_id, n_shared, n_item) for items of which a row of docs(doc_id, mark, text) holds at least `share`; equal marks mean equal rows, which are reported once."""
    spark = docs.sparkSession
    schema = "doc_id long, mark long, item_id long, n_shared int, n_item int"
    items = saved(items.select("item_id", "text").mapInPandas(_item_rows(size), "item_id long, n int, band int, items array<long>, keys array<long>"))
    short = not items.filter("n = 1").isEmpty()
    bands = [(int(r["band"]), short) for r in items.select("band").distinct().orderBy("band").toLocalIterator()]  # at most 63
    if not bands:
        return spark.createDataFrame([], schema)
    bloom = spark.sparkContext.broadcast(_bloom(items))
    found = saved(docs.select("doc_id", "mark", "text").mapInArrow(_window_rows(size, bands, bloom), "doc_id long, mark long, hits array<long>, keys array<long>"))
    keyed = items.select("item_id", F.explode("keys").alias("key"))
    keyed = F.broadcast(keyed) if keyed.count() <= BROADCAST_KEYS else keyed
    met = found.select("mark", F.explode("keys").alias("key")).join(keyed, "key").select("mark", "item_id").distinct()
    own = found.groupBy("mark").agg(F.first("doc_id").alias("doc_id"), F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"))
    both = met.join(own, "mark").join(items.select("item_id", "n", "items").dropDuplicates(["item_id"]), "item_id")
    held = both.select("doc_id", "mark", "item_id", F.size(F.array_intersect("hits", "items")).alias("n_shared"), F.col("n").alias("n_item"))
    return held.filter(F.col("n_shared") / F.col("n_item") >= share)


def contained(docs: DataFrame, items: DataFrame, size: int = SIZE, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for items of which a document holds at least `share`; where rows with one id hold an item, the most that one of them holds counts."""
    held = contained_rows(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text"), items, size, share)
    out = held.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.col("n_shared").cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"), F.round("containment", 6).alias("containment"))


SQL = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
v AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(ws[k:k + least({SIZE}, len(ws)) - 1], ' ') AS s, least({SIZE}, len(ws)) AS width FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - {SIZE - 1}) + 1)) AS k FROM v WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
z AS (SELECT DISTINCT width FROM i),
d AS (SELECT DISTINCT rid, doc_id, array_to_string(ws[k:k + width - 1], ' ') AS s FROM (SELECT rid, doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS k FROM w, z WHERE len(ws) >= width))
SELECT doc_id, item_id, max(c) AS n_shared, max(n) AS n_item, round(max(c) / max(n)::DOUBLE, 6) AS containment
FROM (SELECT rid, doc_id, item_id, count(*) AS c, max(n) AS n FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY rid, doc_id, item_id HAVING count(*) >= {SHARE}::DOUBLE * max(n)) GROUP BY doc_id, item_id
"""

"""Best-fit packing planned on a histogram of lengths.

Tokenised documents are cut into pieces of at most `limit` tokens. Sequences are then planned for counts of
lengths, not for documents: best fit, longest first, over a histogram of at most `limit` entries, whatever
the size of the corpus. The plan is a list of slots, each for a range of ranks within one length; a piece
takes the slot that holds its rank. Ranks are given by length and bucket of ids, so no length meets in one task.

A null text is empty: its piece holds the end id alone. A text of many tokens gives many pieces, the first
the shorter one. Rows with equal ids are packed each (ties broken by their digest); other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsignals.llm.textual import saved, table

LIMIT, END_ID, VOCABULARY = 2048, 0, "byte_bpe_50k.json"

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
_encoders: dict[str, Encoder] = {}


def _bytes_of(token: str) -> bytes:
    """The bytes that a token of a byte-level vocabulary stands for: printable ones stand for themselves, the others for 256, 257 ... in order."""
    return bytes(_BYTES[c] for c in token)


_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, for one tokenizer file.

    A plain byte-level BPE whose ids follow the order of its merges is encoded by tiktoken from the same vocabulary, which gives the
    same ids in half the time (held against the library over all code points in the tests); any other by the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.own = self.library = None
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        steps, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] == "BPE" and steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps["add_prefix_space"] and not spec["normalizer"] and _in_order(model, added):
            import tiktoken

            ranks = {_bytes_of(t): i for t, i in model["vocab"].items() if t not in added}
            self.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
            self.special = tuple(added)
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str) -> bytes:
        if self.library:
            ids = self.library.encode(text, add_special_tokens=False).ids
        elif any(s in text for s in self.special):
            ids = self.own.encode(text, allowed_special="all")
        else:
            ids = self.own.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def _in_order(model: dict, added: dict[str, int]) -> bool:
    """Are the ids of merged tokens in the order of the merges?"""
    at = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return at == sorted(at) and len(set(at)) + 256 == len(model["vocab"].keys() - added.keys())


def _pieces(path: str, limit: int, end_id: int, with_ids: bool):
    """For mapInArrow over (doc_id, text). Ids of documents stay in Arrow, so that large ones and nulls pass."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            row, out, ids = [], [], []
            for i, text in enumerate(batch.column(1)):
                held = encoder.encode(text.as_py() or "") + end
                n = len(held) // 4
                start, stop = 0, n % limit or limit
                for piece in range(-(-n // limit)):
                    part = held[4 * start : 4 * stop]
                    row.append(i)
                    out.append((piece, start, stop - start, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    start, stop = stop, stop + limit
            columns = np.array(out, np.int64).reshape(-1, 4).T
            held = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(columns[0].astype(np.int32)), *(pa.array(c) for c in columns[1:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(held + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    return run


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised pieces of documents; with_ids adds the ids themselves."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_pieces(path, limit, end_id, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, last rank, first sequence, offset) for counts of lengths.

    Sequences with the same room are kept as runs of consecutive numbers; a length takes the runs with the least
    room that holds it, until its count is used up, and splits at most one run. So the plan's size depends
    on the number of lengths alone.
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs [first, last) of sequences
    order: list[int] = []
    slots, opened = [], 0

    def put(room: int, first: int, last: int) -> None:
        if not rooms[room]:
            insort(order, room)
        rooms[room].append((first, last))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                each = limit // length
                full, rest = divmod(left, each)
                for many, n in ((each, full), (rest, 1)):
                    if many and n:
                        for i in range(many):
                            slots.append((length, rank, rank + n - 1, opened, i * length))
                            rank += n
                        put(limit - many * length, opened, opened + n)
                        opened += n
                break
            room = order[at]
            first, last = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            n = min(left, last - first)
            if n < last - first:
                put(room, first + n, last)
            slots.append((length, rank, rank + n - 1, first, limit - room))
            put(room - length, first, first + n)
            rank, left = rank + n, left - n
    return slots


def packed(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pieces (doc_id, piece, length, ids_crc32 ...) with sequence_id and offset."""
    spark = cut.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    slots = best_fit(histogram, limit)
    assert len(slots) <= 4 * limit * limit, "the plan is bounded by the number of lengths"
    plan = spark.createDataFrame(pd.DataFrame(slots, columns=["length", "low", "high", "seq", "offset"], dtype="int64"), "length long, low long, high long, seq long, offset long")
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("nth", F.row_number().over(own) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("nth"))
    plan = F.broadcast(plan) if len(slots) <= 200_000 else plan
    placed = ranked.join(plan, (ranked["length"] == plan["length"]) & F.col("rank").between(F.col("low"), F.col("high"))).drop(plan["length"])
    return placed.withColumn("sequence_id", F.col("seq") + F.col("rank") - F.col("low")).drop("bucket", "nth", "first", "rank", "low", "high", "seq")


def pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Documents to packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    out = packed(saved(pieces(docs, path, limit)), limit)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))

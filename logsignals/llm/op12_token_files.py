"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the documents of a range of ids, in order: frames of about FRAME ids, each compressed by itself with its own checksum, then a skippable frame with the
index of documents, then the seek table of zstandard's seekable format (sizes of every frame and the low half of XXH64 of what it holds). So any zstandard reader
can stream a file, and a reader who wants some documents reads the table and the index from the end and decompresses only the frames in which they
lie; a document longer than a frame spans several.

Tasks write files under names of their own; the manifest, a table that Spark commits, lists those of tasks that ended well, so what lost
executors have left behind is never read. Files go to the folder of spark.checkpoint.dir through pyarrow's file systems.

A null or empty text is its end id alone; long texts are cut into frames; rows with equal ids are documents each, in the order of the hash of their
texts; null ids come first; other columns are ignored; an empty table makes no files and no rows. Ids must be whole numbers.
"""

from __future__ import annotations

import atexit
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsignals.llm.op11_fill_in_middle import _flat, _groups
from logsignals.llm.run_codes import RunCodes
from logsignals.llm.textual import saved, shared_folder, table
from logsignals.tables import _drop

#: Ids of a frame, at least (a last frame may hold fewer); a document of more is cut.
FRAME = 65_536
#: Numbers of the seekable format, and the skippable frame of the index (fixed values).
SEEK_MAGIC, TABLE_MAGIC, INDEX_MAGIC, CHECKED = 0x8F92EAB1, 0x184D2A5E, 0x184D2A5D, 0x80
END_ID, VOCABULARY, LEVEL = 1, "word_bpe_49k.json", 1
MANIFEST = "part int, file string, docs long, ids long, bytes long, first_id long, last_id long"


class TokenFileWriter:
    """One file; ids in order of documents."""

    def __init__(self, sink, width: int) -> None:
        self.sink, self.width, self.waiting, self.held = sink, width, [], 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents by id (where known), their token ids one behind another and the number of each."""
        self.docs.append(doc_ids)
        self.known.append(known)
        self.sizes.append(sizes)
        ids = ids.astype(f"<u{self.width}", copy=False)
        ends, at = np.cumsum(sizes), 0
        while len(ids) - at + self.held >= FRAME:  # a frame ends with the document that fills it, or within one that is longer than a frame
            full = int(ends[np.searchsorted(ends, at + FRAME - self.held)])
            full = min(full, at + 2 * FRAME - self.held)
            self._frame(ids[at:full])
            at = full
        if at < len(ids):
            self.waiting.append(ids[at:])
            self.held += len(ids) - at

    def _frame(self, last: np.ndarray) -> None:
        raw = b"".join([*(w.tobytes() for w in self.waiting), last.tobytes()])
        self.waiting, self.held = [], 0
        packed = self.zstd.compress(raw)
        self.sink.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> dict[str, int | None]:
        """Writes index and seek table; what the manifest says of the file."""
        if self.held:
            self._frame(np.empty(0, f"<u{self.width}"))
        docs, known, sizes = (np.concatenate(x) for x in (self.docs, self.known, self.sizes))
        raw = struct.pack("<IQ", self.width, len(docs)) + docs.astype("<i8").tobytes() + sizes.astype("<u8").tobytes() + np.packbits(known).tobytes()
        packed = self.zstd.compress(raw)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        self.entries.append((len(packed) + 8, 0, 0))
        body = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), CHECKED, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)
        real = docs[known]
        return {"docs": len(docs), "ids": int(sizes.sum()), "bytes": sum(e[0] for e in self.entries) + len(body) + 8, "first_id": int(real[0]) if len(real) else None, "last_id": int(real[-1]) if len(real) else None}


class TokenFileReader:
    """One file by its seek table. `opened` counts the frames that were decompressed."""

    def __init__(self, source, size: int) -> None:
        self.source, self.opened = source, 0
        self.zstd = zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKED:
            raise ValueError("the file ends without a seek table")
        self.table = np.frombuffer(self._read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        raw = self.zstd.decompress(self._read(int(self.at[n - 1]) + 8, int(self.table[n - 1, 0]) - 8))
        self.width, docs = struct.unpack_from("<IQ", raw)
        self.docs, self.sizes = np.frombuffer(raw, "<i8", docs, 12), np.frombuffer(raw, "<u8", docs, 12 + 8 * docs).astype(np.int64)
        self.known = np.unpackbits(np.frombuffer(raw, np.uint8, offset=12 + 16 * docs), count=docs).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.frames = np.concatenate([[0], np.cumsum(self.table[:-1, 1])]) // self.width  # the id with which each frame starts
        self.held: tuple[int, np.ndarray] | None = None

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        if not self.held or self.held[0] != k:
            packed, size, sum_ = self.table[k].tolist()
            raw = self.zstd.decompress(self._read(int(self.at[k]), packed), max_output_size=size)
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != sum_:
                raise ValueError(f"frame {k} isn't what the seek table says")
            self.opened += 1
            self.held = k, np.frombuffer(raw, f"<u{self.width}")
        return self.held[1]

    def ids(self, low: int, high: int) -> np.ndarray:
        """The file's ids from low to before high."""
        first, last = np.searchsorted(self.frames, low, "right") - 1, np.searchsorted(self.frames, high, "left")
        parts = [self.frame(k)[max(0, low - self.frames[k]) : high - self.frames[k]] for k in range(first, last)] if high > low else []
        return np.concatenate([np.empty(0, f"<u{self.width}"), *parts])

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs to files in folder, in ascending order of ids, and returns the saved manifest: a row a file. parts: ranges of ids, each a file; the session's shuffle partitions unless given."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, sink, name = RunCodes.of(path), None, None, f"{folder}/{uuid.uuid4().hex}.zst"
        for batch in batches:
            for low, high in _groups(np.diff(_flat(batch.column("text"))[1])):
                part = batch.slice(low, high - low)
                if writer is None:
                    system, place = fs.FileSystem.from_uri(name)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(place, compression=None)
                    writer = TokenFileWriter(sink, np.dtype(coder.ids).itemsize)
                known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                writer.add(part.column("doc_id").fill_null(0).to_numpy(), known, *coder.codes(*_flat(part.column("text")), end_id))
        if writer is not None:
            row = {"part": TaskContext.get().partitionId(), "file": name, **writer.close()}
            sink.close()
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("file", pa.string()), *((c, pa.int64()) for c in ("docs", "ids", "bytes", "first_id", "last_id"))]))

    order = [F.col("doc_id").asc_nulls_first(), "_hash", "_row"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})  # the last so that equal rows can be dealt to several files
    return saved(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of the documents, or of the wanted ids (a short list), for which only the files and frames that hold them are read."""
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    asked = None if wanted is None else np.unique(np.array(wanted, np.int64))
    if asked is not None:
        files = files.filter(F.exists(F.array(*(F.lit(int(w)) for w in asked)).cast("array<bigint>"), lambda w: w.between(F.col("first_id"), F.col("last_id"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                system, place = fs.FileSystem.from_uri(name)
                with system.open_input_file(place) as source:
                    reader = TokenFileReader(source, source.size())
                    rows = np.arange(len(reader.docs)) if asked is None else np.flatnonzero(reader.known & np.isin(reader.docs, asked))
                    for low in _cut(reader.sizes[rows]):
                        yield _documents(reader, rows[low[0] : low[1]], base)

    spread = max(1, manifest.count())  # a task a file
    return files.select("file", "base").repartition(spread, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _cut(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive documents of about a million ids."""
    group = (np.cumsum(sizes) - sizes) // 1_000_000
    at = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]]) if len(sizes) else np.array([0])
    return zip(at[:-1].tolist(), at[1:].tolist())


def _documents(reader: TokenFileReader, rows: np.ndarray, base: int) -> pa.RecordBatch:
    """The documents of the rows of a reader's index; neighbours are read together."""
    runs = np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1)
    ids = np.concatenate([reader.ids(int(reader.starts[r[0]]), int(reader.starts[r[-1] + 1])) for r in runs]).astype("<u4")
    sizes = reader.sizes[rows]
    ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
    binary = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())
    doc_ids = pa.array(reader.docs[rows].astype(np.int64), mask=~reader.known[rows])
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(reader.starts[rows] + base), pa.array(sizes), binary], ["doc_id", "start", "n_tokens", "ids"])


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY))
    atexit.register(_drop, spark, folder)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

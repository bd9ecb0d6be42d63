"""Words, shingles and hashes that several operators share.

A word is a run of bytes without ASCII white space (``[^\\x20\\x09-\\x0D]+``); lower-casing
touches A to Z alone. Both hold on UTF-8 bytes, where every byte of a longer character is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from logsignals.tables import saved, shared_folder, table

__all__ = ["LOWER", "by_text", "SPACE", "UPPER", "WORD", "digest_of", "mixed", "saved", "shared_folder", "shingles_of", "table", "windows_of", "words_of"]

#: Words as a regular expression, for Spark and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_M1, _M2, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of what it returns behave like random numbers."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, none for null."""
    return text.encode().lower().split() if text else []


def shingles_of(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows_of(words, size))


def windows_of(words: list[bytes], size: int) -> np.ndarray:
    """A hash for each run of `size` words, in order; one for the whole sequence if it is shorter."""
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            out = out * _BASE + h[i : len(h) - size + 1 + i]
        return mixed(out + np.uint64(size))


def digest_of(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingle hashes."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(shingles ^ _BASE).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def by_text(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], pd.DataFrame]], schema: str, text_col: str = "text") -> DataFrame:
    """docs without its text, and with what make()'s function returns for it: a row for each text, in order.

    The other columns stay in Arrow, so that ids above 2^53 beside nulls pass as they are.
    """
    keys = [c for c in docs.columns if c != text_col]
    own = StructType.fromDDL(schema)
    arrow = to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            new = pa.RecordBatch.from_pandas(f(batch.column(text_col).to_pylist()), arrow, preserve_index=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *new.columns], [*keys, *arrow.names])

    return docs.mapInArrow(run, StructType([docs.schema[k] for k in keys] + own.fields))

"""Fill-in-middle transformation by displacement scatter, and its inverse.

Texts of a batch lie one behind another in one array of bytes. A scan finds the cuts between tokens; a text's prefix, middle and suffix are
segments of the array, each with the displacement that takes it to its place in the output. A difference array holds where the displacement
changes, its cumulative sum gives every byte its own, and one numpy scatter writes all bytes of the batch; marks go to the places left
free. The inverse finds the marks in the outputs, and a gather by the displacements of the segments between them restores the texts.

Tokens are runs of other characters with the ASCII white space before them, and white space at the end of a text. A text that is null or empty,
holds a mark itself, or isn't chosen by the hash of its id stays plain. A null id hashes as the empty string; rows with equal ids draw the same
numbers, each cut on its own text. Very long texts are a group of their own (13 bytes of memory for each of theirs); other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logsignals.llm.textual import table

MARK = 3  # bytes
#: Forms by number, and the marks of each in the order in which they stand in an output.
FORMS = ("plain", "psm", "spm")
MARKS = {1: (b"<P>", b"<S>", b"<M>"), 2: (b"<S>", b"<P>", b"<M>")}
#: Bytes of texts that are handled together; a longer text alone.
GROUP = 4_000_000
SEED, RATE, SPM_RATE = 42, 50, 80


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each starts and the last ends."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return held, at - at[0]


def _strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _marks_in(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks stand, and the number of the text of each."""
    if len(data) < MARK:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter = data[1:-1]
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & ((letter == ord("P")) | (letter == ord("S")) | (letter == ord("M"))))
    text = np.searchsorted(starts, at, "right") - 1
    whole = at + MARK <= starts[text + 1]
    return at[whole], text[whole]


def token_ends(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where tokens end, over all texts."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.empty(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[starts[1:][np.diff(starts) > 0] - 1] = True
    return np.flatnonzero(ends) + 1


def displacements(size: int, starts: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """By how much each of `size` bytes moves; segments in order, the first at 0: where each starts and by how much its bytes move."""
    kind = np.int32 if size + int(np.abs(moved).max(initial=0)) < 2**31 else np.int64
    change = np.zeros(size + 1, kind)
    np.add.at(change, starts, np.diff(moved, prepend=0).astype(kind))  # segments without bytes start where the next does
    return np.cumsum(change[:size], dtype=kind)


def _segments(starts: np.ndarray, cut1: np.ndarray, cut2: np.ndarray, form: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacement of prefix, middle and suffix of each text, and where the second and third mark of its output stand."""
    begin, p, s = starts[:-1], cut1 - starts[:-1], starts[1:] - cut2
    base, psm, spm = out[:-1], form == 1, form == 2
    prefix = np.select([psm, spm], [base + MARK, base + s + 2 * MARK], base) - begin
    middle = np.where(form > 0, base + p + s + 3 * MARK - cut1, base - begin)
    suffix = np.select([psm, spm], [base + p + 2 * MARK, base + MARK], base + cut2 - begin) - cut2
    return np.stack([prefix, middle, suffix], 1), base + MARK + np.where(psm, p, s), base + 2 * MARK + p + s


def transformed(data: np.ndarray, starts: np.ndarray, h1: np.ndarray, h2: np.ndarray, chosen: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Bytes and starts of the outputs; number of tokens, form, and code points of prefix and middle of each."""
    ends = token_ends(data, starts)
    first = np.searchsorted(ends, starts, "right")
    n = np.diff(first)
    form = np.where(chosen & (np.diff(starts) > 0), np.where(spm, 2, 1), 0)
    form[_marks_in(data, starts)[1]] = 0
    one, two = h1 % (n + 1), h2 % (n + 1)
    after = np.concatenate([ends, [0]])
    cut = lambda k: np.where(k > 0, after[first[:-1] + k - 1], starts[:-1])
    cut1, cut2 = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    out_starts = np.concatenate([[0], np.cumsum(np.diff(starts) + 3 * MARK * (form > 0))])
    moved, second, third = _segments(starts, cut1, cut2, form, out_starts)
    to = displacements(len(data), np.stack([starts[:-1], cut1, cut2], 1).ravel(), moved.ravel())
    to += np.arange(len(data), dtype=to.dtype)
    out = np.empty(out_starts[-1], np.uint8)
    out[to] = data
    for number, marks in MARKS.items():
        own = form == number
        for place, mark in zip((out_starts[:-1][own], second[own], third[own]), marks):
            for k, byte in enumerate(mark):
                out[place + k] = byte
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return out, out_starts, {"n": n, "form": form, "prefix_chars": points[cut1] - points[starts[:-1]], "middle_chars": points[cut2] - points[cut1]}


def restored(data: np.ndarray, starts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and starts of the texts from those of outputs and their forms."""
    at, text = _marks_in(data, starts)
    moved_texts, cut = np.flatnonzero(form > 0), form[text] > 0
    if not np.array_equal(text[cut], np.repeat(moved_texts, 3)):
        raise ValueError("an output that isn't plain has three marks")
    at = at[cut].reshape(-1, 3)
    out = np.concatenate([[0], np.cumsum(np.diff(starts) - 3 * MARK * (form > 0))])
    # where prefix, middle and suffix lie in the output, and their lengths
    lie = np.repeat(starts[:-1, None], 3, 1)
    length = np.stack([np.diff(starts), *np.zeros((2, len(form)), np.int64)], 1)
    first, second = at[:, 1] - at[:, 0] - MARK, at[:, 2] - at[:, 1] - MARK
    psm = form[moved_texts] == 1
    lie[moved_texts] = np.stack([np.where(psm, at[:, 0], at[:, 1]), at[:, 2], np.where(psm, at[:, 1], at[:, 0])], 1) + MARK
    length[moved_texts] = np.stack([np.where(psm, first, second), starts[1:][moved_texts] - at[:, 2] - MARK, np.where(psm, second, first)], 1)
    begin = out[:-1, None] + np.cumsum(length, 1) - length
    lie = np.where(length > 0, lie, begin)  # of a segment without bytes any displacement will do
    come = displacements(int(out[-1]), begin.ravel(), (lie - begin).ravel())
    come += np.arange(len(come), dtype=come.dtype)
    return data[come], out


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about GROUP bytes."""
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > GROUP:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, starts = _flat(batch.column("text"))
        for low, high in _groups(np.diff(starts)):
            part = batch.slice(low, high - low)
            column = lambda name: part.column(name).to_numpy(zero_copy_only=False)
            out, at, found = transformed(*_flat(part.column("text")), *(column(c) for c in ("h1", "h2", "chosen", "spm")))
            found["form"] = pa.array(FORMS).take(pa.array(found["form"]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values()), _strings(out, at).cast(pa.string())], ["doc_id", *found, "output"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output. `rate` hundredths of texts are cut, `spm_rate` hundredths of those suffix first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring("_digest", 8 * i - 7, 8), 16, 10).cast("long")
    drawn = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("_digest"))
    drawn = drawn.select("doc_id", "text", number(1).alias("h1"), number(2).alias("h2"), (number(3) % 100 < rate).alias("chosen"), (number(4) % 100 < spm_rate).alias("spm"))
    out = drawn.mapInArrow(_scatter, f"doc_id {drawn.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    known: Column = F.col("form") != "plain"
    return out.withColumns({c: F.when(known, F.col(c)) for c in ("prefix_chars", "middle_chars")})


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """outputs with `restored`: the texts, from outputs and forms alone."""
    names = outputs.columns

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, starts = _flat(batch.column(output_col))
            for low, high in _groups(np.diff(starts)):
                part = batch.slice(low, high - low)
                form = np.array([FORMS.index(f) for f in part.column(form_col).to_pylist()], np.int64)
                texts = _strings(*restored(*_flat(part.column(output_col)), form)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*names, "restored"])

    return outputs.mapInArrow(gather, StructType([*outputs.schema.fields, StructField("restored", StringType())]))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2, ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS k1, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS k2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:k1], '') AS pre, array_to_string(units[k1 + 1:k2], '') AS mid, array_to_string(units[k2 + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

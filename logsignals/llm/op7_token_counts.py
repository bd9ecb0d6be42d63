"""Exact token counts at every prefix of a text, by dynamic programming.

A run is a stretch without ASCII white space. The tokenizer drops white space and never joins across it, so the count of a prefix is
that of its whole runs, a running sum, and that of the part of the run that is cut. A text's table holds the end and the running count of
every run. Within a run a second table holds the count at every code point: BPE codes a prefix of a word as it codes the word without
what follows, so the code of each prefix is that of a shorter one and one more token, namely the token that ends there and stays apart from the
last token before it (`Bpe`). Truncation ("how much of the text fits in B tokens?") and budget questions are then looked up: no text
is encoded again. Counts of runs, tables within runs and pairs of tokens are remembered across texts.

A run is cut into pieces where the tokenizer itself begins a new word whatever precedes or follows (`borders`), so the table of a run is that of its pieces, one after
another. Pieces in which a cut changes more than the last word (shortened words like 'll, special tokens, characters that change under NFC or change their
length in lower case) have their table from the library, prefix by prefix, a bounded number at once.

Null and empty texts have no runs and 0 tokens; very long texts only have longer tables (linear, but for a single piece of the odd kind, which takes the square of its own length in time); repeated rows
are counted each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from unicodedata import category, is_normalized

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsignals.llm.textual import by_text, table

RUN = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of a run as the tokenizer splits it (fixed by it, but for what ODD has); runs whose prefixes may be split otherwise.
WORD, ODD = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"), re.compile("['\u03a3]|<\\|")
#: The character that stands for each byte in the vocabulary: itself if it is printable, else 256, 257 ... in order.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
CHARACTERS = [chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)]
#: What the tokenizer takes off a word as one (fixed by it).
SHORTENED = re.compile("'(?:s|t|re|ve|m|ll|d)", re.IGNORECASE | re.ASCII)
#: Characters of prefixes that are encoded together.
TOGETHER = 500_000
#: Runs that a worker remembers; then it starts anew (memory only).
REMEMBERED = 400_000
#: Texts are handled in groups of about so many characters.
GROUP = 4_000_000
VOCABULARY = "word_bpe_49k.json"

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
_encoders: dict[str, PrefixCounter] = {}


class Bpe:
    """Codes of all prefixes of a word under a BPE with a suffix for the end of words, from its merges."""

    def __init__(self, model: dict) -> None:
        self.vocabulary, self.suffix = model["vocab"].keys(), model["end_of_word_suffix"] or ""
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocabulary))
        self.apart: dict[tuple[tuple[str, ...], tuple[str, ...]], bool] = {}

    def code(self, symbols: list[str]) -> list[str]:
        """BPE as it is defined: the pair of the least rank is merged until none is left."""
        while len(symbols) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.rank):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _stay(self, one: tuple[str, ...], two: tuple[str, ...]) -> bool:
        """Are these symbols coded as two tokens with the border between them?"""
        ok = self.apart.get((one, two))
        if ok is None:
            ok = self.code([*one, *two]) == ["".join(one), "".join(two)] if one else self.code(list(two)) == ["".join(two)]
            if len(self.apart) > REMEMBERED:  # memory
                self.apart.clear()
            self.apart[one, two] = ok
        return ok

    def prefixes(self, word: str) -> list[int]:
        """Tokens of word[:k] as a word of its own, for k from 1. word is in the vocabulary's alphabet."""
        last: list[tuple[str, ...]] = [()]  # last token of word[:j] if more of the word follows
        inner, out = [0], []
        for j in range(1, len(word) + 1):
            for ends in (False, True):
                for i in range(max(0, j - self.longest), j):
                    text = word[i:j] + self.suffix * ends
                    if text in self.vocabulary:
                        token = (*word[i : j - 1], word[j - 1] + self.suffix * ends)
                        if self._stay(last[i], token):
                            if ends:
                                out.append(inner[i] + 1)
                            else:
                                last.append(token)
                                inner.append(inner[i] + 1)
                            break
        return out


def _kind(c: str) -> str:
    """Letter, number or other sign, as the tokenizer sees a character; ? where what stands beside it may change that."""
    if c.isalpha():
        low = c.lower()
        return "L" if len(low) == 1 and low.isalpha() else "?"
    return "N" if category(c)[0] == "N" else "O" if c.isascii() else "?"


def borders(run: str, special: re.Pattern | None = None) -> list[int]:
    """Places at which the tokenizer begins a new word of a run, whatever follows: those between special tokens, and where such a token ends."""
    out, start = [], 0
    for m in special.finditer(run) if special else ():
        out += [start + p for p in _borders(run[start : m.start()])] + [m.end()]
        start = m.end()
    return [p for p in (*out, *(start + p for p in _borders(run[start:]))) if p < len(run)]


def _borders(run: str) -> list[int]:
    """The character at a border is ASCII, so nothing is composed over the place. Numbers stand alone; between letters and signs there is a border, but not behind an apostrophe that begins a shortened word, whose own end is one."""
    kinds = [_kind(c) for c in run]
    out, behind = [], -1  # behind: where a shortened word ends
    for p in range(1, len(run)):
        a, b = kinds[p - 1], kinds[p]
        if run[p - 1] == "'" and (p == 1 or kinds[p - 2] in "LN" or p - 1 == behind):
            m = SHORTENED.match(run, p - 1)
            behind = m.end() if m else behind
            cut = b != "O" and not m
        else:
            cut = p == behind or "N" in (a, b) or a != b
        unknown = a == "?" or run[p - 1] == "'" and p > 1 and kinds[p - 2] == "?"
        if cut and not unknown and run[p].isascii():
            out.append(p)
    return out


class PrefixCounter:
    """Prefix tables for one tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.inner: dict[str, np.ndarray] = {}
        self.pieces: dict[str, np.ndarray] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bpe = Bpe(spec["model"])
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    @classmethod
    def of(cls, path: str) -> PrefixCounter:
        """One per worker process."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def learn(self, runs: list[list[str]]) -> None:
        new = list(set(chain.from_iterable(runs)).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set(chain.from_iterable(runs)))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.known.update(zip(part, (len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))

    def table(self, text: str, runs: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(end of each run in code points, tokens up to there); learn() has seen the runs if they are given."""
        if runs is None:
            runs = RUN.findall(text)
            self.learn([runs])
        counts = np.cumsum(np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs)))
        ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)) + 1) - 1
        if runs and (ends[-1] != len(text) or text.isspace()):  # not one white space between runs and none around them
            ends = np.fromiter((m.end() for m in RUN.finditer(text)), np.int64, len(runs))
        return ends, counts

    def within(self, run: str) -> np.ndarray:
        """Tokens of run[:k] for k from 0 to its length."""
        held = self.inner.get(run)
        if held is None:
            if len(self.inner) > REMEMBERED // 10:
                self.inner.clear()
            if self._odd(run):
                cuts = [0, *borders(run, self.special), len(run)]
                parts = [self._piece(run[a:b]) for a, b in zip(cuts, cuts[1:])]
                ends = np.cumsum([int(x[-1]) for x in parts])
                held = np.concatenate([[0], *(x[1:] + e - int(x[-1]) for x, e in zip(parts, ends))])
            else:
                held = self._plain(run)
            self.inner[run] = held
        return held

    @staticmethod
    def _odd(run: str) -> bool:
        return bool(ODD.search(run)) or not is_normalized("NFC", run) or any(len(c.lower()) > 1 or c.isspace() for c in run)

    def _plain(self, run: str) -> np.ndarray:
        counts, done = [0], 0
        for word in WORD.findall(run.lower()):
            size = [len(c.encode()) for c in word]
            at = self.bpe.prefixes("".join(CHARACTERS[b] for b in word.encode()))
            counts += [done + at[k - 1] for k in np.cumsum(size).tolist()]
            done = counts[-1]
        return np.array(counts)

    def _piece(self, piece: str) -> np.ndarray:
        held = self.pieces.get(piece)
        if held is None:
            if self._odd(piece):
                counts, step = [0], max(1, TOGETHER // len(piece))
                for low in range(1, len(piece) + 1, step):
                    counts += [len(e) for e in self.tokenizer.encode_batch_fast([piece[:k] for k in range(low, min(low + step, len(piece) + 1))], add_special_tokens=False)]
                held = np.array(counts)
            else:
                held = self._plain(piece)
            if len(self.pieces) > REMEMBERED // 10:
                self.pieces.clear()
            self.pieces[piece] = held
        return held

    def at(self, text: str, prefix: int, tabled: tuple[np.ndarray, np.ndarray] | None = None) -> int:
        """Tokens of text[:prefix]."""
        ends, counts = tabled or self.table(text)
        k = int(np.searchsorted(ends, prefix, "right"))
        done, start = (int(counts[k - 1]), int(ends[k - 1])) if k else (0, 0)
        run = RUN.search(text, start) if k < len(ends) else None
        return done + (int(self.within(run.group())[prefix - run.start()]) if run and run.start() < prefix else 0)

    def fit(self, text: str, budget: int, tabled: tuple[np.ndarray, np.ndarray] | None = None) -> int:
        """The most code points of text that take at most `budget` tokens."""
        ends, counts = tabled or self.table(text)
        k = int(np.searchsorted(counts, budget, "right"))
        if k == len(ends):
            return len(text)
        done, start = (int(counts[k - 1]), int(ends[k - 1])) if k else (0, 0)
        run = RUN.search(text, start)
        return run.start() + int(np.flatnonzero(self.within(run.group()) <= budget - done)[-1])


def _counts(path: str, budget: int, tables: bool):
    counter = PrefixCounter.of(path)

    def count(texts: list[str | None]) -> pd.DataFrame:
        tokens, fits, ends, counts = [], [], [], []
        for some in _grouped([t or "" for t in texts]):
            runs = [RUN.findall(t) for t in some]
            counter.learn(runs)
            for text, own in zip(some, runs):
                tabled = counter.table(text, own)
                tokens.append(int(tabled[1][-1]) if own else 0)
                fits.append(counter.fit(text, budget, tabled))
                if tables:
                    ends.append(tabled[0])
                    counts.append(tabled[1])
        return pd.DataFrame({"n_tokens": tokens, "fit_chars": fits} | ({"ends": ends, "counts": counts} if tables else {}))

    return count


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size > GROUP:
            yield some
            some, size = [], 0
    if some:
        yield some


def token_counts(docs: DataFrame, path: str, budget: int = 2048, tables: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and fit_chars (code points of whole words within the budget); with `tables` the prefix tables too."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return by_text(docs, lambda: _counts(path, budget, tables), "n_tokens long, fit_chars long" + ", ends array<long>, counts array<long>" * tables)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fit_chars")

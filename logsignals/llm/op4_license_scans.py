"""License scans: fuzzy search for short notices by pigeonhole seeds and bounded-error matching.

A notice of n characters may have up to k edits; cut into k + 1 seeds, at least one of them stands unchanged in any
match. Each seed found in a text's normal form (words joined by single spaces) gives a window of its own, and
the regex library's bounded-error matching verifies it and reports the span and its edits, if the words that tell the license from others (TELLING) stand in it unedited; where a closer match takes a part of a window, the rest is searched again. Base places, where a phrase's words
stand consecutively, are counted in words apart from that.

Null texts have no words; long texts are searched whole, in time in proportion but for the windows; of matches that overlap the
closest stays, of equally close ones the longest, then the first; equal rows count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsignals.llm.textual import by_text, table

#: Words, in bytes of lower-cased UTF-8: letters, digits and whatever isn't ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Base phrases (fixed by the contract) and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Words that tell a license from others of like wording, by label: they must stand unedited within a match.
TELLING = {"mit": ("mit",), "apache-2": ("apache", "2"), "cc-by-nc": ("nc",), "cc-by-sa": ("sa",), "gpl-3": ("gnu", "3"), "gpl-2": ("gnu", "2"), "mpl-2": ("mozilla", "2")}
#: Short notices that are searched with edits, and their labels. Of a license's telling words those count that a notice has.
NOTICES = {
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license version 2": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
#: Characters of a notice for each edit that is allowed.
PER_EDIT = 10


class NoticeFinder:
    """Notices with edits in one text of normal form."""

    def __init__(self, notices: dict[str, str], per_edit: int = PER_EDIT) -> None:
        self.notices = []
        for notice, label in notices.items():
            k = len(notice) // per_edit
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            seeds = [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]
            telling = [f" {w} " for w in TELLING.get(label, ()) if w in notice.split(" ")]
            self.notices.append((notice, label, k, telling, seeds, regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
        self.seeds = {}
        for at, (*_, seeds, _) in enumerate(self.notices):
            for seed, start in seeds:
                self.seeds.setdefault(seed, []).append((at, start))
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for seed, uses in self.seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, similarity) of matches; where some overlap, the one of the best similarity stays."""
        windows: set[tuple[int, int, int]] = set()
        text = f" {text} "  # every word stands between spaces
        for last, (size, uses) in self.automaton.iter(text):
            for at, start in uses:
                notice, _, k, *_ = self.notices[at]
                low = last + 1 - size - start - k
                windows.add((at, max(1, low), min(len(text) - 1, low + len(notice) + 2 * k)))
        best = [m for w in windows if (m := self._best(text, *w))]
        heapify(best)
        kept: list[tuple[str, int, int, int, float]] = []
        starts: list[int] = []
        while best:
            _, _, start, label, end, edits, at, low, high = heappop(best)
            i = bisect(starts, start)
            if (not i or kept[i - 1][2] <= start) and (i == len(kept) or end <= starts[i]):
                starts.insert(i, start)
                kept.insert(i, (label, start, end, edits, 1 - edits / len(self.notices[at][0])))
            for a, b in self._free(kept, starts, low, high):  # what is left of the window may hold a worse match
                if m := self._best(text, at, a, b):
                    heappush(best, m)
        return [(label, start - 1, end - 1, edits, share) for label, start, end, edits, share in kept]

    @staticmethod
    def _told(text: str, telling: list[str], low: int, high: int) -> bool:
        """Do all telling words stand between low and high?"""
        return all(text.find(w, low - 1, high + 1) >= 0 for w in telling)

    def _best(self, text: str, at: int, low: int, high: int) -> tuple | None:
        """The closest match of a notice in a window, in the order of spans(), with the window."""
        notice, label, k, telling, _, pattern = self.notices[at]
        begin = low
        while high - begin >= len(notice) - k and self._told(text, telling, begin, high) and (m := pattern.search(text, begin, high)) and m.end() > m.start():
            if self._told(text, telling, m.start(), m.end()):
                edits = sum(m.fuzzy_counts)
                return edits / len(notice), m.start() - m.end(), m.start(), label, m.end(), edits, at, low, high
            begin = m.start() + 1
        return None

    @staticmethod
    def _free(kept: list[tuple[str, int, int, int, float]], starts: list[int], low: int, high: int) -> Iterator[tuple[int, int]]:
        """The parts of a window between kept spans."""
        i = max(0, bisect(starts, low) - 1)
        while i < len(kept) and starts[i] < high:
            if starts[i] > low:
                yield low, starts[i]
            low = max(low, kept[i][2])
            i += 1
        if low < high:
            yield low, high


def base_places(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """(word, label) of every place where the words of a phrase stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if tuple(words[at : at + len(phrase)]) == phrase:
                    out.append((at, label))
        except ValueError:
            pass
    return sorted(out)


def _scanned(notices: dict[str, str], base: dict[str, str], per_edit: int):
    finder = NoticeFinder(notices, per_edit)
    phrases = {tuple(p.encode().split()): label for p, label in base.items()}

    def scan(texts: list[str | None]) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = WORD.findall((text or "").encode().lower())
            places = base_places(words, phrases)
            spans = finder.spans(b" ".join(words).decode())
            labels = {label for _, label in places}
            score = max([1.0 if places else 0.0, *(s[4] for s in spans)])
            found = [{"label": a, "start": b, "end": c, "edits": d} for a, b, c, d, _ in spans]
            rows.append((len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})), score, found))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan


def license_scans(docs: DataFrame, notices: dict[str, str] = NOTICES, per_edit: int = PER_EDIT) -> DataFrame:
    """One row per document with base counts, labels, score, and spans in the text's normal form."""
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:long>>"
    return by_text(docs.select("doc_id", "text"), lambda: _scanned(notices, BASE, per_edit), schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans(table(spark, sf_dir, "documents"))

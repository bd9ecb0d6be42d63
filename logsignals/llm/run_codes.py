"""Token ids of whole texts through a memory of the codes of their runs.

The tokenizer drops white space and never joins across it, and it lower-cases, so the ids of a text are those of its segments, one after
another: runs without ASCII white space, in which one sign after a letter or digit at the end is a segment of its own. Segments of
at most 23 bytes are packed into three numbers with their length, an exact key, and are looked up for a whole group of texts at once in an open-addressing
table; those it hasn't are encoded by the library and added. Longer segments, and whole texts that hold the start of a special token, go to the library one by one.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already

KEY = 23
SLOTS = 1 << 22
#: Codes that are remembered; then the memory starts anew (memory only, results don't depend on it).
REMEMBERED = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b".,;:!?")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Words that the tokenizer takes as one, whatever stands around them.
_WORD = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: The first n of eight bytes, by n.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_coders: dict[str, RunCodes] = {}


class RunCodes:
    """Ids by segment for one tokenizer file whose words end in a suffix and whose white space is dropped."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, suffix = self.library.get_vocab(), spec["model"]["end_of_word_suffix"]
        if not suffix or spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
            raise ValueError("the tokenizer must drop white space and mark the ends of words")
        self.ids = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    @classmethod
    def of(cls, path: str) -> RunCodes:
        """One per worker process."""
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def _forget(self) -> None:
        self.keys, self.entry = np.zeros((SLOTS, 3), np.uint64), np.full(SLOTS, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.starts, self.n = np.zeros(1 << 16, np.int64), 0  # of the codes in the arena; entry k is from k to k + 1
        self.arena = np.zeros(1 << 18, self.ids)

    def _add(self, codes: np.ndarray, sizes: np.ndarray) -> int:
        """Codes of new entries, one behind another; the number of the first."""
        end = int(self.starts[self.n]) + len(codes)
        while end > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        while self.n + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        first, self.n = self.n, self.n + len(sizes)
        self.arena[end - len(codes) : end] = codes
        self.starts[first + 1 : self.n + 1] = self.starts[first] + np.cumsum(sizes)
        return first

    def _encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each segment, by the library: plain words in lines of many, others by themselves."""
        texts = b"\n".join(segments).decode().split("\n")  # no segment holds white space
        plain = [_WORD.fullmatch(t) is not None for t in texts]
        sizes, parts, own = np.zeros(len(texts), np.int64), [], np.flatnonzero(plain)
        for low in range(0, len(own), 2_000):
            line = own[low : low + 2_000]
            ids = np.array(self.library.encode(" ".join([texts[i] for i in line.tolist()]), add_special_tokens=False).ids, self.ids)
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) != len(line):
                raise ValueError("a plain word is one word of the tokenizer")
            sizes[line] = np.diff(cuts, prepend=0)
            parts.append(ids)
        rest = np.flatnonzero(~np.array(plain, bool))
        for low in range(0, len(rest), 2_000):
            line = rest[low : low + 2_000]
            coded = [e.ids for e in self.library.encode_batch_fast([texts[i] for i in line.tolist()], add_special_tokens=False)]
            sizes[line] = np.fromiter(map(len, coded), np.int64, len(coded))
            parts.append(np.fromiter(chain.from_iterable(coded), self.ids))
        order, held = np.concatenate([own, rest]), np.concatenate([np.empty(0, self.ids), *parts])
        lie = np.empty(len(texts), np.int64)
        lie[order] = np.cumsum(sizes[order]) - sizes[order]
        return held[np.repeat(lie - np.cumsum(sizes) + sizes, sizes) + np.arange(len(held))], sizes

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _M[0] ^ keys[:, 1] * _M[1] ^ keys[:, 2] * _M[2]
        return ((h ^ (h >> np.uint64(32))) * _M[0] >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of keys, -1 where there is none."""
        at, out, open_ = self._slots(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(open_):
            found = self.entry[at]
            held = self.keys[at]
            same = (found >= 0) & (held[:, 0] == keys[:, 0]) & (held[:, 1] == keys[:, 1]) & (held[:, 2] == keys[:, 2])
            out[open_[same]] = found[same]
            on = (found >= 0) & ~same
            open_, keys, at = open_[on], keys[on], (at[on] + 1) & (SLOTS - 1)
        return out

    def _insert(self, keys: np.ndarray, first: int) -> None:
        """Distinct new keys with the entries from first on."""
        at, new = self._slots(keys), np.arange(first, first + len(keys), dtype=np.int32)
        while len(new):
            free = self.entry[at] < 0
            self.entry[at[free]] = new[free]
            won = self.entry[at] == new
            self.keys[at[won]] = keys[won]
            keys, new, at = keys[~won], new[~won], (at[~won] + 1) & (SLOTS - 1)

    def codes(self, data: np.ndarray, starts: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind another, and their number for each; end_id follows each text. data, starts: bytes and where each text starts and the last ends."""
        texts = len(starts) - 1
        if self.n > REMEMBERED:
            self._forget()
        stop = self._add(np.array([] if end_id is None else [end_id], self.ids), np.array([end_id is not None], np.int64))
        space = _SPACE[data]
        before = np.concatenate([[True], space])[:-1]
        filled = starts[:-1][np.diff(starts) > 0]
        before[filled] = True
        begin = ~space & before
        after = np.concatenate([space, [True]])[1:]
        after[filled[1:] - 1] = True
        sign = _SIGN[data] & after
        sign[1:] &= _PLAIN[data[:-1]]
        sign &= ~begin
        whole = self._special(data, starts)
        for a, b in whole:
            begin[a:b] = sign[a:b] = False
            begin[a] = True
        at = np.flatnonzero(begin | sign)
        finish = np.flatnonzero(after & ~space) + 1
        for a, b in whole:
            finish = finish[(finish <= a) | (finish > b)]
        finish = np.sort(np.concatenate([finish, np.flatnonzero(sign), *([b] for _, b in whole)])).astype(np.int64)
        size = finish - at
        entries = np.empty(len(at), np.int64)
        short = size <= KEY
        for a, _ in whole:
            short[np.searchsorted(at, a)] = False
        entries[short] = self._short(data, at[short], size[short])
        special = {a for a, _ in whole}
        for k in np.flatnonzero(~short).tolist():
            entries[k] = self._single(data[at[k] : finish[k]].tobytes(), int(at[k]) not in special)
        bounds = np.searchsorted(at, starts)
        entries = np.insert(entries, bounds[1:], stop)
        bounds = bounds + np.arange(texts + 1)
        low = self.starts[entries]
        n = self.starts[entries + 1] - low
        place = np.concatenate([[0], np.cumsum(n)])
        ids = self.arena[np.repeat(low - place[:-1], n) + np.arange(place[-1])]
        return ids, np.diff(place[bounds])

    def _special(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """Texts in which a special token may stand."""
        hits = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        return [(int(starts[i]), int(starts[i + 1])) for i in np.unique(np.searchsorted(starts, hits, "right") - 1).tolist()]

    def _single(self, segment: bytes, lower: bool) -> int:
        segment = segment.lower() if lower else segment
        entry = self.long.get(segment)
        if entry is None:
            ids = np.array(self.library.encode(segment.decode(), add_special_tokens=False).ids, self.ids)
            entry = self._add(ids, np.array([len(ids)]))
            if len(segment) < 200:
                self.long[segment] = entry
        return entry

    def _short(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        padded = _LOWER[np.concatenate([data, np.zeros(KEY + 1, np.uint8)])]
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,))  # the eight bytes from each place on
        out = np.empty(len(at), np.int64)
        for low in range(0, len(at), 100_000):
            own, n = at[low : low + 100_000], size[low : low + 100_000]
            keys = np.empty((len(own), 3), np.uint64)
            for k in range(3):
                keys[:, k] = eight[own + 8 * k] & _KEPT[np.clip(n - 8 * k, 0, 8)]
            keys[:, 2] |= n.astype(np.uint64) << np.uint64(56)
            found = self._find(keys)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                new = _distinct(keys[missing])
                rows = new.view(np.uint8)
                if self.n + len(new) > SLOTS * 3 // 4:
                    raise MemoryError("a group of texts has more distinct segments than the table holds")
                first = self._add(*self._encode([r[: r[KEY]].tobytes() for r in rows]))
                self._insert(new, first)
                found[missing] = self._find(keys[missing])
            out[low : low + 100_000] = found
        return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = keys[np.lexsort(keys.T)]
    return keys[np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])]

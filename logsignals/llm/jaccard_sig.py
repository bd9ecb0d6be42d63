"""PartEnum signatures of shingle sets (numpy part of the n-gram Jaccard join).

The domain of 64-bit shingle hashes is cut into `n1` ranges, each again into `n2`; a signature
is the content of n2 - k2 of the n2 inner ranges of one outer range. Sets of one band of sizes
whose symmetric difference is at most k < n1 * (k2 + 1) share a signature, since some outer
range holds at most k2 of the differences. With `spare` ranges beyond that, some of more than `spare` ranges agree, so empty
contents, which any two sets may share, need a signature only in a set with more than `spare` ranges that have one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

from logsignals.llm.textual import mixed



@lru_cache(maxsize=64)
def bands(percent: int, most: int) -> np.ndarray:
    """Lower ends of the bands of sizes: sets of similarity percent / 100 or more lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


@lru_cache(maxsize=4096)
def plan(upper: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for sets of at most `upper` members: |s ^ t| <= (|s| + |t|) * (100 - p) / (100 + p).

    For few differences, subsets of three of four inner ranges keep signatures selective; for many, one range for each difference
    costs the fewest signatures (k + 1, as two inner ranges do) and needs the fewest spare ones.
    """
    k = 2 * upper * (100 - percent) // (100 + percent)
    n2, k2 = (4, 1) if k <= 20 else (1, 0)
    needed = -(-(k + 1) // (k2 + 1))
    spare = 2 + (needed // 24 if k2 else needed * 3 // 20)
    return needed + spare, n2, k2, spare


@lru_cache(maxsize=64)
def subsets(n2: int, k2: int) -> np.ndarray:
    return np.array(list(combinations(range(n2), n2 - k2)))


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """64-bit signatures of a sorted set of distinct shingle hashes: those of its band of sizes and of the next."""
    n = len(shingles)
    if not n:
        return np.empty(0, np.uint64)
    edges = bands(percent, max(1024, 1 << int(n).bit_length() + 1))
    own = int(np.searchsorted(edges, n, "right")) - 1
    out = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles), dtype=np.uint64)])
        for band in (own, own + 1):
            n1, n2, k2, most_empty = plan(int(edges[band + 1]) - 1, percent)
            cuts = np.searchsorted(shingles, _starts(n1 * n2))
            at = np.append(cuts, n)
            held = np.diff(at).reshape(n1, n2)
            content = np.diff(sums[at]).reshape(n1, n2) + held.astype(np.uint64)
            chosen = subsets(n2, k2)
            filled = held[:, chosen].sum(2) > 0
            salted = mixed(content + mixed(np.arange(n1 * n2, dtype=np.uint64) + np.uint64(band << 32)).reshape(n1, n2))
            sig = mixed(salted[:, chosen].sum(2, dtype=np.uint64) + np.arange(len(chosen), dtype=np.uint64))
            short = (~filled).any(1).sum() > most_empty
            out.append(sig.ravel() if short else sig[filled])
    return np.concatenate(out)


@lru_cache(maxsize=4096)
def _starts(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(parts)], np.uint64)

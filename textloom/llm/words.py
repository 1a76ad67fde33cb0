"""Words and word n-grams of whole batches of texts, hashed in numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Hashes are
64-bit and depend on the words alone, not on the batch.
"""

from __future__ import annotations

import numpy as np

from textloom.llm.chunking import digests

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of each text of a batch: starts and ends in the bytes, hashes, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool) -> None:
        if lower:
            data = LOWER[data]
        solid = ~SPACE[data]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[edge] = solid[edge]
        stops = solid.copy()
        stops[:-1] &= ~solid[1:]
        stops[edge - 1] = solid[edge - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.hashes = digests(data, self.starts, self.ends) if len(self.starts) else np.empty(0, np.uint64)
        self.first = np.searchsorted(self.starts, offsets)  # the first word of each text, and one past the last
        self.counts = np.diff(self.first)

    def grams(self, n: int) -> np.ndarray:
        """A hash of each run of n words, at its first word; only those inside one text mean anything."""
        return grams(self.hashes, n)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Runs of n, put together from runs of powers of two; entry i covers i .. i + n - 1, and the last n - 1 entries nothing."""
    out, at, power, run = None, 0, 1, mix(hashes)
    while True:
        if n & power:
            if out is None:
                out = run
            else:
                later = np.zeros_like(run)
                later[: len(run) - at] = run[at:]
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + later + np.uint64(power))
            at += power
        power *= 2
        if power > n:
            return out  # type: ignore[return-value]
        later = np.zeros_like(run)
        half = power // 2
        later[: max(0, len(run) - half)] = run[half:]
        run = mix(run * np.uint64(0xD6E8FEB86659FD93) + later + np.uint64(power << 8))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles, lower-cased and sorted; fewer words make one shingle, none an empty set."""
    words = Words(data, offsets, lower=True)
    whole = words.grams(n)
    first, counts = words.first.tolist(), words.counts.tolist()
    short: dict[int, np.ndarray] = {}
    out = []
    for a, c in zip(first, counts, strict=False):
        if c >= n:
            s = np.sort(whole[a : a + c - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s)
        elif c:
            if c not in short:
                short[c] = words.grams(c) + np.uint64(c)
            out.append(short[c][a : a + 1].copy())
        else:
            out.append(np.empty(0, np.uint64))
    return out

"""Word shingles of many texts at once, as 64-bit hashes worked out with numpy over the texts' bytes."""

from __future__ import annotations

import numpy as np

from bookloom.llm.common import LOWER, mix64

_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[np.frombuffer(LOWER, np.uint8)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), 0x2545F4914F6CDD1D, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at white space) of all texts in a row, and how many each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = _SPACE[data]
    before = np.concatenate([[True], gap[:-1]])
    starts = np.flatnonzero(~gap & before)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
    bounds = np.cumsum(sizes)
    counts = np.diff(np.searchsorted(starts, bounds, side="left"), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    ends = np.flatnonzero(gap & ~before)
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
        if place is None:
            place = np.arange(len(data)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
        powers = _powers(int((ends - starts).max()) + 1)
        value = np.where(gap, np.uint64(0), _TABLE[data] * powers[np.where(gap, 0, place)])
        return mix64(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text its distinct width-word shingles in order of hash; fewer words are one shingle, none an empty set."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        mixed = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width):
            mixed = mix64(mixed * np.uint64(0x9FB21C651E98DF25) + words[k : k + len(mixed)] + np.uint64(k + 1))
        for n in counts:
            if n >= width:
                out.append(np.unique(mixed[at : at + n - width + 1]))
            elif n:
                h = np.uint64(n)
                for w in words[at : at + n]:
                    h = mix64(np.array([h * np.uint64(0xC2B2AE3D27D4EB4F) + w]))[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out

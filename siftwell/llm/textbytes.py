"""Words of many texts at once, as offsets into one byte array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import joined_bytes, ranges

#: A random odd base, and a random number for each byte: what hashes of runs are made of.
BASE = 0x9E3779B97F4A7C15
LETTERS = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64, endpoint=False)

#: True for the bytes 0x20 and 0x09 to 0x0D, which part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """``data``: all words, each with one blank after it; word ``i`` is ``data[begin[i]:end[i]]``;
    document ``d`` has words ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, column: pa.Array, lower: bool = False, space: np.ndarray = SPACE):
        raw, ends = joined_bytes(column, b" ")
        if lower:
            raw = LOWER[raw]
        gap = space[raw]
        stop = gap.copy()  # the first gap after each word
        stop[1:] &= ~gap[:-1]
        stop[:1] = False
        keep = ~gap | stop
        self.data = raw[keep]
        self.end = np.flatnonzero(stop[keep])
        self.data[self.end] = 32
        self.begin = np.concatenate([[0], self.end[:-1] + 1])[: len(self.end)]
        self.first = np.searchsorted(np.flatnonzero(stop), ends, "left")
        self.docs = len(ends) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(28))


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """XXH64 of each word's bytes."""
    return xxh64(w.data, w.begin, w.end, seed)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of every run of ``size`` words; a shorter document is one run of all its words, or none."""
    n = words.counts()
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    start = ranges(words.first[:-1], count)
    doc = np.repeat(np.arange(words.docs), count)
    last = np.minimum(start + size, words.first[1:][doc]) - 1
    return words.begin[start], words.end[last], doc


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each ``data[begin:end]``: vectorised below 32 bytes, the library beyond."""
    import xxhash

    out = np.zeros(len(begin), np.uint64)
    if not len(begin):
        return out
    size = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    kinds = np.minimum(size, 32).astype(np.uint8)
    order = np.argsort(kinds, kind="stable")
    bounds = np.searchsorted(kinds[order], np.arange(33, dtype=np.uint8))
    for n in range(32):
        at = order[bounds[n] : bounds[n + 1]]
        if len(at):
            out[at] = _short(eight, begin[at], n, seed)
    blob = data.tobytes()
    for i in order[bounds[32] :].tolist():
        out[i] = xxhash.xxh64_intdigest(blob[begin[i] : end[i]], seed)
    return out


def _short(eight: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(at), np.uint64(seed) + P5 + np.uint64(n))
        done = 0
        while done + 8 <= n:
            k = eight[at + done].view("<u8")[:, 0]
            h ^= _rot(k * P2, 31) * P1
            h = _rot(h, 27) * P1 + P4
            done += 8
        if done + 4 <= n:
            k = np.ascontiguousarray(eight[at + done][:, :4]).view("<u4")[:, 0].astype(np.uint64)
            h ^= k * P1
            h = _rot(h, 23) * P2 + P3
            done += 4
        while done < n:
            h ^= eight[at + done, 0].astype(np.uint64) * P5
            h = _rot(h, 11) * P1
            done += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h

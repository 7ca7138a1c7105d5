"""Vectorised word scanning: word bounds and 64-bit word hashes of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes that separate words.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
PUNCT = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of more bytes are hashed one by one.
LONG = 64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Keeps the first so many bytes of a lane of eight.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def separators(which: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    word = np.ones(256, bool)
    word[list(which)] = False
    return word


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def scan(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (byte positions), and for each text the index of its first word (texts + 1)."""
    inside = word[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges; those of two seeds are unrelated.

    Eight bytes at a time are mixed in by ``mix``, so that no sums or products of letters cancel out whatever the words
    are; ranges of more than LONG bytes are hashed by BLAKE2b. Unlike ranges share a hash by chance alone.
    """
    size = ends - starts
    value = size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed)
    if not len(starts):
        return value
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[size[at] > k] if k else at
        if not len(at):
            break
        lane = lanes[starts[at] + k] & _KEEP[np.minimum(size[at] - k, 8)]
        value[at] = mix((value[at] ^ lane) + np.uint64(_BASE))
    for k in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        value[k] = np.frombuffer(digest, np.uint64)[0]
    return value


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within each text (a shorter text gives one run of all its words), and each text's first run."""
    counts = np.diff(first)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(runs, out=at[1:])
    value = np.zeros(at[-1], np.uint64)
    long = np.flatnonzero(counts >= n)
    if len(h) >= n and len(long):
        rolled = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            rolled = mix(rolled + h[k : len(h) - n + 1 + k])
        begin = np.repeat(first[:-1][long] - at[:-1][long], runs[long])
        place = np.concatenate([np.arange(0)]) if not len(long) else np.flatnonzero(np.repeat(counts >= n, runs))
        value[place] = rolled[place + begin]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        x = np.zeros(1, np.uint64)
        for k in range(first[d], first[d + 1]):
            x = mix(x + h[k : k + 1])
        value[at[d]] = mix(x + np.uint64(counts[d]))[0]
    return value, at

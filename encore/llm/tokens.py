"""Vectorised word splitting and hashing over a column of UTF-8 texts."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.default_rng(20240607)
_PLACES = 1 << 14
#: Bytes of words hashed at a time.
HASH_BYTES = 1 << 18
#: A random odd multiplier for each place within a word, places beyond repeat.
PLACE = _RNG.integers(0, 2**63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A random value for each byte; A-Z stand as a-z.
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[0x41:0x5B] = BYTE[0x61:0x7B]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def split_words(data: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the number of words before each text (one more than texts).

    Words are maximal runs of bytes that ``space`` does not mark; none spans two texts.
    """
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = ends[:-1][ends[:-1] < data.size]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = ends[1:][ends[1:] > 0] - 1
    last[cuts] = inside[cuts]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, byte: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hash of each word's bytes (a random linear form per place, then mixed).

    Bytes are spread into 8-byte terms HASH_BYTES at a time, so the memory besides the hashes does
    not follow the texts, however long one of them or one of its words is.
    """
    length = stops - starts
    total = np.cumsum(length)
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(total, total[i] - length[i] + HASH_BYTES, "right"))
        if j > i:
            out[i:j] = _linear_forms(data, starts[i:j], length[i:j], byte)
        else:
            j = i + 1
            for at in range(0, int(length[i]), HASH_BYTES):
                lo = int(starts[i]) + at
                run = data[lo : min(lo + HASH_BYTES, int(stops[i]))]
                out[i : i + 1] += (byte[run] * PLACE[np.arange(at, at + len(run)) & (_PLACES - 1)]).sum(dtype=np.uint64)
        i = j
    return mix64(out + length.astype(np.uint64))


def _linear_forms(data: np.ndarray, starts: np.ndarray, length: np.ndarray, byte: np.ndarray) -> np.ndarray:
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    values = byte[data[np.repeat(starts, length) + place]] * PLACE[place & (_PLACES - 1)]
    return np.add.reduceat(values, at)


def shingles(words: np.ndarray, before: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words (fewer words: the whole text as one), and their numbers before each text.

    Hashes repeat as the runs do. A text without words has none.
    """
    count = np.diff(before)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    runs_before = np.concatenate([[0], np.cumsum(runs)])
    total = int(runs_before[-1])
    first = np.repeat(before[:-1] - runs_before[:-1], runs) + np.arange(total)
    out = np.zeros(total, np.uint64)
    length = np.repeat(np.minimum(count, size), runs)
    for k in range(size):
        have = length > k
        out[have] += words[first[have] + k] * PLACE[k] if not have.all() else words[first + k] * PLACE[k]
    return mix64(out + length.astype(np.uint64)), runs_before

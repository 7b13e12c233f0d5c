"""Statistics of whole texts, for the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from encore.llm.common import text_bytes
from encore.llm.tokens import SPACE, mix64, split_words, word_hashes

NAMES = (
    "words", "word_length", "word_spread", "upper", "digit", "mark", "symbol", "exclaim", "space", "capitals",
    "marked_words", "upper_words", "variety", "top_word", "repeats", "triples", "line_words", "line_repeats", "stops", "lone_symbols",
)


def _table(*ranges: range | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[list(r)] = True
    return out


_UPPER, _DIGIT = _table(range(0x41, 0x5B)), _table(range(0x30, 0x3A))
_MARK = _table(b".,;:!?'\"()-")
_SYMBOL = _table(b"#$%&*+/<=>@[\\]^_`{|}~")
_LINE = _table([0x0A, 0x0D])


def _share(flags: np.ndarray, ends: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Per text: flags set over ``total``."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), ends)) / np.maximum(total, 1)


def _distinct(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct values, and the count of the most frequent."""
    n = len(before) - 1
    owner = np.repeat(np.arange(n), np.diff(before))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    if not len(v):
        return np.zeros(n), np.zeros(n)
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(v)))
    most = np.zeros(n)
    np.maximum.at(most, o[at], runs)
    return np.bincount(o[at], minlength=n).astype(float), most


def _log_share(x: np.ndarray) -> np.ndarray:
    return np.log(x + 1e-3)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics (NAMES) per text; null and empty texts have those of no words.

    Counts go through log(1 + x), shares through log(x + 0.001): near normal, and finite everywhere.
    """
    data, ends = text_bytes(column)
    starts, stops, before = split_words(data, ends)
    hashes = word_hashes(data, starts, stops)
    size, words = np.diff(ends), np.diff(before)
    length = stops - starts
    sums = np.concatenate([[0], np.cumsum(length)])
    squares = np.concatenate([[0], np.cumsum(length.astype(float) ** 2)])
    some = np.maximum(words, 1)
    mean = (sums[before[1:]] - sums[before[:-1]]) / some
    spread = np.sqrt(np.maximum((squares[before[1:]] - squares[before[:-1]]) / some - mean**2, 0))

    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    final = data[stops - 1] if len(starts) else np.zeros(0, np.uint8)
    second = data[np.minimum(starts + 1, stops - 1)] if len(starts) else np.zeros(0, np.uint8)
    distinct, most = _distinct(hashes, before)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[before[:-1][before[:-1] < len(hashes)]] = False
    # triples of words; the last two words of a text start none and share the value 0
    triples = np.zeros(len(hashes), np.uint64)
    if len(hashes) > 2:
        triples[:-2] = mix64(hashes[:-2] + mix64(hashes[1:-1] + mix64(hashes[2:])))
        for back in (1, 2):
            last = before[1:][words >= back] - back
            triples[last] = 0
    triple_kinds, _ = _distinct(triples, before)
    lines, line_ends, lines_before = split_words(data, ends, _LINE)
    line_hash = word_hashes(data, lines, line_ends)
    line_kinds, _ = _distinct(line_hash, lines_before)
    line_count = np.diff(lines_before)

    return np.column_stack([
        np.log1p(words),
        np.log1p(mean),
        np.log1p(spread),
        _log_share(_share(_UPPER[data], ends, size)),
        _log_share(_share(_DIGIT[data], ends, size)),
        _log_share(_share(_MARK[data], ends, size)),
        _log_share(_share(_SYMBOL[data], ends, size)),
        _log_share(_share(data == 0x21, ends, size)),
        _log_share(_share(SPACE[data], ends, size)),
        _log_share(_share(_UPPER[first] & ~_UPPER[second], before, words)),
        _log_share(_share(_SYMBOL[final] | (final == 0x21), before, words)),
        _log_share(_share(_UPPER[first] & _UPPER[second] & (length > 1), before, words)),
        np.log1p(distinct) / np.log1p(some),
        _log_share(most / some),
        _log_share(_share(again, before, words)),
        _log_share(1 - triple_kinds / some),
        np.log1p(words / np.maximum(line_count, 1)),
        _log_share(1 - line_kinds / np.maximum(line_count, 1)),
        _log_share(_share(final == 0x2E, before, words)),
        _log_share(_share((length == 1) & _SYMBOL[first], before, words)),
    ])

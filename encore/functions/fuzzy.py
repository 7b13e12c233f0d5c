"""Fuzzy similarity (Z1) and candidates for misspelt names (Z3).

``ratio(a, b) = 100 * 2 * LCS(a, b) / (len(a) + len(b))`` (normalised indel
similarity, as published for the partial-ratio metric);
``partial_ratio`` takes the best ratio of the shorter string against every
window of the longer one, including windows cut by either end. Levenshtein
is not equivalent (it allows substitutions). Scored in a pandas UDF,
and only on candidate rows.

The longest common subsequence is computed on machine words: a bit a position of the shorter
string, one addition and a few logical operations a character of the window. Windows whose
characters, counted, cannot beat the best so far are passed over.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(4096)
def _places(text: str) -> dict[str, int]:
    """For each character, the positions at which it stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence.

    A zero in ``open`` at position i says that the subsequence of ``a[:i + 1]`` is one longer than
    that of ``a[:i]``; the carry of the addition moves each such step to the first match after it.
    """
    places, full = _places(a), (1 << len(a)) - 1
    left = full
    for c in b:
        hit = left & places.get(c, 0)
        left = (left + hit | left - hit) & full
    return len(a) - left.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    return 100.0 * 2 * lcs(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """Symmetric: of strings of one length, each is tried as the one inside the other."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(a, b) if len(a) < len(b) else _best_window(b, a)


def _best_window(short: str, long_: str) -> float:
    m, n = len(short), len(long_)
    need = Counter(short)
    # characters of the window, and how many of them could be matched at all
    have: Counter = Counter()
    shared, best = 0, 0.0
    for end in range(1, n + m):
        if end <= n:
            c = long_[end - 1]
            have[c] += 1
            shared += have[c] <= need[c]
        if end > m:
            c = long_[end - m - 1]
            shared -= have[c] <= need[c]
            have[c] -= 1
        lo, hi = max(0, end - m), min(n, end)
        if 200.0 * shared / (m + hi - lo) <= best:
            continue
        r = ratio(short, long_[lo:hi])
        if r > best:
            best = r
            if best == 100.0:
                break
    return best


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [partial_ratio(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)],
        dtype="float64",
    )


def partial_ratio_column(a: Column, b: Column) -> Column:
    """Z1 as a column: a string that contains the other scores 100 in the JVM; only the others go to Python."""
    inside = b.contains(a) | a.contains(b)
    rest = partial_ratio_udf(F.when(~inside, a), F.when(~inside, b))
    return F.when(inside, F.lit(100.0)).otherwise(rest)


# ---------------------------------------------------------------- Z3 trigrams
#: Edits allowed in a misspelt query: one, and one more for every so many characters.
CHARACTERS_AN_EDIT = 5


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, in lower case; shorter texts have none."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
    runs = F.transform(starts, lambda i: F.substr(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def misspelt_as(query: str) -> tuple[list[str], int]:
    """The query's trigrams, and how many of them a text shares at least that holds it with no more than the allowed edits.

    An edit destroys three runs of three at most, so no such text has fewer (at least one is asked for).
    """
    low = query.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    edits = max(1, len(low) // CHARACTERS_AN_EDIT)
    return grams, max(1, len(grams) - 3 * edits)

"""Order statistics and pages of a sorted result, without sorting more than the part asked for (L1, L3).

A bounded sample of the sort keys gives splitters; one count a range between splitters tells where
the wanted position lies, and the same is done again inside that range until what is left to sort
is small. A table of N rows takes about log(N / RANGE_ROWS) / log(RANGES) rounds, each a scan with a
partial count; no task holds more than RANGE_ROWS rows however deep the position is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from encore.session import written

#: Rows that one task may sort; ranges of a round; sampled rows a range.
RANGE_ROWS, RANGES, SAMPLED = 100_000, 32, 32


@dataclass(frozen=True)
class Key:
    """A column to sort by. Keys together must tell all rows apart, or ties keep an order of chance."""

    name: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def first(self) -> bool:
        """Whether nulls come first; unless said, as in Spark: first if ascending, last if descending."""
        return not self.descending if self.nulls_first is None else self.nulls_first

    @property
    def order(self) -> Column:
        c = F.col(f"`{self.name}`")
        if self.descending:
            return c.desc_nulls_first() if self.first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.first else c.asc_nulls_last()

    def compared(self, bound: Row) -> tuple[Column, Column]:
        """Whether a row's key comes after the bound's, and whether it is the same."""
        c, value = F.col(f"`{self.name}`"), bound[self.name]
        if value is None:
            return (c.isNotNull() if self.first else F.lit(False)), c.isNull()
        later = c < F.lit(value) if self.descending else c > F.lit(value)
        return F.coalesce(later, F.lit(not self.first)), F.coalesce(c == F.lit(value), F.lit(False))


def keys_of(*names: str) -> list[Key]:
    return [Key(n) for n in names]


def _from(keys: Sequence[Key], bound: Row, equal: bool) -> Column:
    """Whether a row comes after ``bound`` in the order, or is it (``equal``)."""
    out = F.lit(equal)
    for key in reversed(keys):
        later, same = key.compared(bound)
        out = later | (same & out)
    return out


def not_before(keys: Sequence[Key], bound: Row) -> Column:
    return _from(keys, bound, True)


def not_after(keys: Sequence[Key], bound: Row) -> Column:
    return ~_from(keys, bound, False)


def _splitters(df: DataFrame, keys: Sequence[Key], rows: int, ranges: int) -> list[Row]:
    """Keys that cut ``df`` into about even ranges, from a sample of about ranges x SAMPLED rows."""
    names = [k.name for k in keys]
    sample = df.select(*[F.col(f"`{n}`") for n in names])
    share = ranges * SAMPLED / max(1, rows)
    if share < 1:
        place = F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in names]), F.lit(1 << 40))
        sample = sample.filter(place < int(share * (1 << 40)))
    found = sample.distinct().orderBy(*[k.order for k in keys]).collect()
    step = max(1, len(found) // ranges)
    return found[step::step]


def sorted_range(
    df: DataFrame, keys: Sequence[Key], offset: int, limit: int, range_rows: int = RANGE_ROWS, ranges: int = RANGES
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df`` in the order of ``keys``.

    Near the start this is one top-k. Deeper, ``df`` is scanned twice a round, so a costly ``df`` should be a written table.
    """
    order = [k.order for k in keys]
    part, skip = df, offset
    rows = df.count() if skip + limit > range_rows else None
    while rows is not None and skip + limit > range_rows:
        if skip >= rows:
            return df.limit(0)
        bounds = _splitters(part, keys, rows, ranges)
        number = reduce(lambda a, b: a + b, [not_before(keys, b).cast("int") for b in bounds], F.lit(0))
        count = dict(part.groupBy(number.alias("r")).count().collect())
        before, lo, hi = 0, None, len(bounds)
        for r in range(len(bounds) + 1):
            n = count.get(r, 0)
            if lo is None and skip < before + n:
                lo, start = r, before
            if lo is not None and skip + limit <= before + n:
                hi = r
                break
            before += n
        left = sum(n for r, n in count.items() if lo <= r <= hi)
        if left == rows:
            break  # equal keys, or a page as long as the table
        if lo > 0:
            part = part.filter(not_before(keys, bounds[lo - 1]))
        if hi < len(bounds):
            part = part.filter(~not_before(keys, bounds[hi]))
        skip, rows = skip - start, left
    return part.orderBy(*order).offset(skip).limit(limit)


def kth(df: DataFrame, keys: Sequence[Key], k: int, range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> Row | None:
    """The k-th smallest key (from 1) of ``df``; None if it has fewer rows."""
    found = sorted_range(df.select(*[F.col(f"`{x.name}`") for x in keys]), keys, k - 1, 1, range_rows, ranges).collect()
    return found[0] if found else None


def in_order(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    return df.orderBy(*[k.order for k in keys])


def first_rows(df: DataFrame, keys: Sequence[Key], k: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The first ``k`` rows of ``df`` in the order of ``keys``, for a ``k`` of any size.

    Up to ``range_rows`` this is one top-k. Beyond, the rows are written once, the k-th key is found by counts, and
    what does not come after it is sorted over many tasks. Only rows that share the k-th key are limited in one task.
    """
    if k <= range_rows:
        return in_order(df, keys).limit(k)
    df = written(df, "first-rows")
    last = kth(df, keys, k, range_rows)
    if last is None:
        return in_order(df, keys)
    before = df.filter(~not_before(keys, last))
    ties = df.filter(not_before(keys, last) & not_after(keys, last)).limit(k - before.count())
    return in_order(before.unionByName(ties), keys)

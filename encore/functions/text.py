"""Text predicates and clean-up used across operators.

Substring filters follow SQL ``LIKE '%q%'`` semantics: case-insensitive, with
``%`` and ``_`` typed by the user acting as wildcards. An explicit escape
character is always set (Spark's default backslash would turn ``%\\c%`` into
an error); ``~`` typed by the user is doubled so it stays literal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPE_CHAR = "~"


def like_pattern(query: str) -> str:
    """``%q%`` with the escape character itself escaped."""
    return "%" + query.replace(ESCAPE_CHAR, ESCAPE_CHAR + ESCAPE_CHAR) + "%"


def contains_ci(column: Column | str, query: str) -> Column:
    """``column ILIKE '%query%' ESCAPE '~'`` as a Catalyst expression."""
    col = F.col(column) if isinstance(column, str) else column
    return F.ilike(col, F.lit(like_pattern(query)), F.lit(ESCAPE_CHAR))


def any_contains_ci(columns: list[Column | str], query: str) -> Column:
    """OR of substring matches over several columns (browse filter)."""
    return reduce(lambda a, b: a | b, [contains_ci(c, query) for c in columns])

"""SQL LIKE with a pattern that comes from data: case-insensitive, ``_`` and ``%`` wild."""

from pyspark.sql import Column, functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def escape_backslash(c) -> Column:
    """The source dialect has no escape character, Spark's is the backslash."""
    return F.replace(_col(c), F.lit("\\"), F.lit("\\\\"))


def has_wildcard(c) -> Column:
    return _col(c).rlike("[_%]")


def contains_like(haystack, needle) -> Column:
    """``haystack LIKE '%' || needle || '%'``; plain needles skip the regex engine."""
    h, n = F.lower(_col(haystack)), F.lower(_col(needle))
    pattern = F.concat(F.lit("%"), escape_backslash(n), F.lit("%"))
    return F.when(has_wildcard(n), F.like(h, pattern)).otherwise(F.contains(h, n))


def ends_like(text, suffix) -> Column:
    """``text LIKE '%' || suffix``."""
    t, s = F.lower(_col(text)), F.lower(_col(suffix))
    pattern = F.concat(F.lit("%"), escape_backslash(s))
    return F.when(has_wildcard(s), F.like(t, pattern)).otherwise(F.endswith(t, s))


def like_text(c, pattern: str) -> Column:
    """``c LIKE pattern`` for a pattern known when the plan is built."""
    return _col(c).ilike(pattern.replace("\\", "\\\\"))

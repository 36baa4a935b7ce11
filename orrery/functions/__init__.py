"""Column functions that the operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Memory scoring constants. Fixed values.
DEFAULT_HALFLIFE, DEFAULT_IMPORTANCE = 604_800, 0.5


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob in which only * and ? are special."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def glob_match(column: Column | str, glob: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    if "?" not in glob and glob.count("*") == 1 and glob.endswith("*"):
        return column.startswith(glob[:-1])  # reaches the scan as a prefix filter
    return column.rlike(glob_pattern(glob))


def glob_match_column(column: Column, glob: Column) -> Column:
    """As glob_match(), with the glob in a column."""
    quoted = F.concat(F.lit(r"(?s)^\Q"), F.replace(F.replace(F.replace(glob, F.lit(r"\E"), F.lit("")), F.lit("*"), F.lit(r"\E.*\Q")), F.lit("?"), F.lit(r"\E.\Q")), F.lit(r"\E$"))
    return F.regexp_like(column, quoted)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, added up in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def recency(created_at: Column, halflife: Column, now: int) -> Column:
    """0.5 to the power of the age in half-lives; half-lives of 0 or less count as the default."""
    age = F.greatest(F.lit(now) - created_at, F.lit(0)).cast("double")
    return F.pow(F.lit(0.5), age / F.when(halflife > 0, halflife).otherwise(F.lit(DEFAULT_HALFLIFE)))


def frequency(access_count: Column) -> Column:
    return 0.5 + 0.5 * F.least(F.lit(1.0), F.log2(access_count + 1.0) / 10.0)


def composite(similarity: Column, recent: Column, importance: Column, frequent: Column, boost: str | None = None) -> Column:
    """The product of the factors, one of them squared if boosted."""
    factors = {"similarity": similarity, "recency": recent, "importance": importance, "frequency": frequent}
    if boost is not None and boost not in factors:
        raise ValueError(f"boost is one of {sorted(factors)}")
    out = F.lit(1.0)
    for name, f in factors.items():
        out = out * f * (f if name == boost else F.lit(1.0))
    return out


def live(expires_at_ms: Column, now_ms: int) -> Column:
    """Key-value entries are expired only after their time."""
    return expires_at_ms.isNull() | (F.lit(now_ms) <= expires_at_ms)


def slice_bounds(start: int, stop: int, size: Column) -> tuple[Column, Column]:
    """First and last position of an inclusive range with negative numbers counted from the end, cut to what there is."""
    first = F.greatest(F.lit(start) if start >= 0 else size + start, F.lit(0))
    last = F.least(F.lit(stop) if stop >= 0 else size + stop, size - 1)
    return first, last

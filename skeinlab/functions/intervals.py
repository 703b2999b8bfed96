"""Interval ends and persistence bars.

An end is a struct (side, value, open): side -1 or 1 for the infinities, whose value and open are 0,
and 0 for numbers; so structs compare as ends do: closed before open at one value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest filtration values of each type.
SENTINELS = {"double": (float("-inf"), float("inf")), "float": (float("-inf"), float("inf")), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "long": (-(2**63), 2**63 - 1)}


def sentinel(kind: str, largest: bool) -> Column:
    return F.lit(SENTINELS[kind][largest]).cast(kind)


def _end(side: int, value: Column, is_open: int) -> Column:
    return F.struct(F.lit(side).alias("side"), value.cast("double").alias("value"), F.lit(is_open).alias("open"))


def closed(value: Column) -> Column:
    return _end(0, value, 0)


def opened(value: Column) -> Column:
    return _end(0, value, 1)


def minus_infinity() -> Column:
    return _end(-1, F.lit(0.0), 0)


def plus_infinity() -> Column:
    return _end(1, F.lit(0.0), 0)


def flip(end: Column) -> Column:
    """Open and closed change places; infinities stay."""
    return F.struct(end["side"].alias("side"), end["value"].alias("value"), F.when(end["side"] == 0, 1 - end["open"]).otherwise(end["open"]).alias("open"))


def is_finite(end: Column) -> Column:
    return end["side"] == 0


def bar(dim: Column, lower: Column | None = None, upper: Column | None = None, annotation: Column | None = None) -> Column:
    """A bar; without ends the whole line, with a lower one [lower, infinity)."""
    lower = minus_infinity() if lower is None else lower
    upper = plus_infinity() if upper is None else upper
    fields = [dim.cast("int").alias("dim"), lower.alias("lower"), upper.alias("upper")]
    return F.struct(*fields, *([annotation.alias("annotation")] if annotation is not None else []))


def _shape(lower, upper):
    return lambda dim, *ends: bar(dim, lower(ends[0]) if lower in (closed, opened) else lower(), upper(ends[-1]) if upper in (closed, opened) else upper())


#: The nine shapes of an interval, by how it starts and ends.
bc = clop = _shape(closed, opened)
clcl, opcl, opop = _shape(closed, closed), _shape(opened, closed), _shape(opened, opened)
clinf, opinf = _shape(closed, plus_infinity), _shape(opened, plus_infinity)
infcl, infop = _shape(minus_infinity, closed), _shape(minus_infinity, opened)


def show(b: Column) -> Column:
    """dim: [lower,upper) with signs for the infinities."""
    lower, upper = b["lower"], b["upper"]
    left = F.when(lower["side"] != 0, "(-∞").otherwise(F.concat(F.when(lower["open"] == 1, "(").otherwise("["), lower["value"].cast("string")))
    right = F.when(upper["side"] != 0, "∞)").otherwise(F.concat(upper["value"].cast("string"), F.when(upper["open"] == 1, ")").otherwise("]")))
    return F.concat(b["dim"].cast("string"), F.lit(": "), left, F.lit(","), right)

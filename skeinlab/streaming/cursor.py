"""A cursor over a filtration: what lies before a value, and what a later value adds.

Nothing here is event time: cells are ordered by value, so advancing is a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def advance_to(cells: DataFrame, t: float) -> DataFrame:
    return cells.filter(F.col("f") < t)


def between(cells: DataFrame, a: float, b: float) -> DataFrame:
    """What advancing from a to b adds."""
    return cells.filter((F.col("f") >= a) & (F.col("f") < b))


def advance_dimension(cells: DataFrame, dim: int, t: float = float("inf")) -> DataFrame:
    return cells.filter((F.col("dim") <= dim) & (F.col("f") < t))

"""Free modules: vectors of a fixed length over integers or a field, as expressions on array columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlab.functions.fields import Reals


@dataclass(frozen=True)
class Vectors:
    """Arrays of n scalars. ring has plus, minus, times, negate and is_zero on columns, as the fields have."""

    n: int
    ring: Any = Reals()
    kind: str = "double"

    def zero(self) -> Column:
        return F.array_repeat(F.lit(0).cast(self.kind), self.n)

    def plus(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, self.ring.plus)

    def minus(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, self.ring.minus)

    def negate(self, a: Column) -> Column:
        return F.transform(a, self.ring.negate)

    def scale(self, by: Column, a: Column) -> Column:
        """by times a; a times by is the same, as scalars commute."""
        return F.transform(a, lambda x: self.ring.times(by, x))

    def is_zero(self, a: Column) -> Column:
        return F.forall(a, self.ring.is_zero)

    def equal(self, a: Column, b: Column) -> Column:
        return self.is_zero(self.minus(a, b))

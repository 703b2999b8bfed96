"""Coefficient fields, as column expressions and as scalars for the grouped kernels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reals:
    """Doubles; numbers closer than eps are equal."""

    eps: float = 1e-9

    def norm(self, a: Column) -> Column:
        return a.cast("double")

    def is_zero(self, a: Column) -> Column:
        return F.abs(a) < self.eps

    def is_equal(self, a: Column, b: Column) -> Column:
        return F.abs(a - b) < self.eps

    def plus(self, a: Column, b: Column) -> Column:
        return a + b

    def minus(self, a: Column, b: Column) -> Column:
        return a - b

    def times(self, a: Column, b: Column) -> Column:
        return a * b

    def negate(self, a: Column) -> Column:
        return -a

    def invert(self, a: Column) -> Column:
        return F.when(a != 0, F.lit(1.0) / a).otherwise(F.raise_error(F.lit("zero has no inverse")).cast("double"))

    def divide(self, a: Column, b: Column) -> Column:
        return a * self.invert(b)

    # scalars
    def number(self, a: float) -> float:
        return 0.0 if abs(a) < self.eps else float(a)

    def quotient(self, a: float, b: float) -> float:
        return a / b


@dataclass(frozen=True)
class Prime:
    """Integers modulo a prime; numbers are kept between -(p-1)/2 and (p-1)/2 (for 2: 0 and 1)."""

    p: int = 2

    def __post_init__(self) -> None:
        if self.p < 2 or any(self.p % d == 0 for d in range(2, int(self.p**0.5) + 1)):
            raise ValueError(f"{self.p} is no prime")

    def unsigned(self, a: Column) -> Column:
        return F.pmod(a.cast("long"), F.lit(self.p).cast("long"))

    def norm(self, a: Column) -> Column:
        r = self.unsigned(a)
        return F.when(r > (self.p - 1) // 2, r - self.p).otherwise(r) if self.p > 2 else r

    def show(self, a: Column) -> Column:
        return F.concat(F.lit("Fp("), self.norm(a).cast("string"), F.lit(")"))

    def is_zero(self, a: Column) -> Column:
        return self.unsigned(a) == 0

    def is_equal(self, a: Column, b: Column) -> Column:
        return self.unsigned(a - b) == 0

    def plus(self, a: Column, b: Column) -> Column:
        return self.norm(a + b)

    def minus(self, a: Column, b: Column) -> Column:
        return self.norm(a - b)

    def times(self, a: Column, b: Column) -> Column:
        return self.norm(self.unsigned(a) * self.unsigned(b))

    def negate(self, a: Column) -> Column:
        return self.norm(-a)

    def invert(self, a: Column) -> Column:
        """By a table of inverses; zero raises an error."""
        table = F.array(*(F.lit(pow(i, -1, self.p) if i else 0).cast("long") for i in range(self.p)))
        return F.when(self.is_zero(a), F.raise_error(F.lit("zero has no inverse")).cast("long")).otherwise(self.norm(F.get(table, self.unsigned(a).cast("int"))))

    def divide(self, a: Column, b: Column) -> Column:
        return self.times(a, self.invert(b))

    # scalars
    def number(self, a: float) -> int:
        r = int(a) % self.p
        return r - self.p if self.p > 2 and r > (self.p - 1) // 2 else r

    def quotient(self, a: int, b: int) -> int:
        return self.number(a * pow(int(b) % self.p, -1, self.p))


def deferred(expression: str) -> Column:
    """Arithmetic put off until a query runs: a SQL expression, whose constants Catalyst folds."""
    return F.expr(expression)


def from_int(n: int) -> Column:
    """n as a sum of ones, for fields that are given by zero, one and plus alone."""
    out = F.lit(0.0)
    for _ in range(abs(n)):
        out = out + F.lit(1.0)
    return out if n >= 0 else -out

"""Raised and lowered digits and signs, and printed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs and their raised and lowered forms.
PLAIN, RAISED, LOWERED = "0123456789+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"


def superscript(text: Column) -> Column:
    return F.translate(text, PLAIN, RAISED)


def subscript(text: Column) -> Column:
    return F.translate(text, PLAIN, LOWERED)


def translation(text: Column, table: dict[str, str]) -> Column:
    """Signs replaced by a table of single signs, or of strings."""
    if all(len(k) == 1 and len(v) == 1 for k, v in table.items()):
        return F.translate(text, "".join(table), "".join(table.values()))
    for k, v in table.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def show_chain(terms: Column) -> Column:
    """array<struct<cell, coeff>> as 1.0⊠∆(1,2) + ..."""
    from skeinlab.functions.simplex import show

    return F.array_join(F.transform(terms, lambda t: F.concat(t["coeff"].cast("string"), F.lit("⊠"), show(t["cell"]))), " + ")

"""Chains: tables chain(chain_id, cell, coeff), a row for each term."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlab.functions.fields import Reals
from skeinlab.functions.simplex import boundary as terms
from skeinlab.functions.simplex import filtered_key


def of_cells(cells: DataFrame) -> DataFrame:
    """A chain of one term, coefficient 1, for each row (chain_id, cell)."""
    return cells.select("chain_id", "cell", F.lit(1.0).alias("coeff"))


def collapse(chains: DataFrame, field=Reals()) -> DataFrame:
    """Terms of the same cell are added, zeros go."""
    return chains.groupBy("chain_id", "cell").agg(field.norm(F.sum("coeff")).alias("coeff")).filter(~field.is_zero(F.col("coeff")))


def zero_chains(ids: DataFrame, chains: DataFrame, field=Reals()) -> DataFrame:
    """Those of ids (chain_id) whose chain is zero."""
    return ids.join(collapse(chains, field), "chain_id", "left_anti")


def items(chains: DataFrame) -> DataFrame:
    return chains.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("cell", "coeff"))).alias("terms"))


def equal(a: DataFrame, b: DataFrame, field=Reals()) -> DataFrame:
    """chain_id and equal, for the ids of either table."""
    x, y = collapse(a, field).withColumnRenamed("coeff", "ca"), collapse(b, field).withColumnRenamed("coeff", "cb")
    both = x.join(y, ["chain_id", "cell"], "full")
    same = F.coalesce(field.is_equal(F.col("ca"), F.col("cb")), F.lit(False))
    ids = a.select("chain_id").union(b.select("chain_id")).distinct()
    return ids.join(both.groupBy("chain_id").agg(F.bool_and(same).alias("equal")), "chain_id", "left").select("chain_id", F.coalesce("equal", F.lit(True)).alias("equal"))


def leading_term(chains: DataFrame, cells: DataFrame, field=Reals()) -> DataFrame:
    """chain_id, cell and coeff of the latest cell by (f, dim, vertices); a zero chain has none."""
    own = collapse(chains, field).join(cells.select("cell", "f"), "cell")
    key = filtered_key(F.col("f"), F.col("cell"))
    return own.groupBy("chain_id").agg(F.max(F.struct(key.alias("k"), "coeff")).alias("t")).select("chain_id", F.col("t.k.cell").alias("cell"), F.col("t.coeff").alias("coeff"))


def plus(a: DataFrame, b: DataFrame, field=Reals()) -> DataFrame:
    return collapse(a.select("chain_id", "cell", "coeff").unionByName(b.select("chain_id", "cell", "coeff")), field)


def scale(chains: DataFrame, by, field=Reals()) -> DataFrame:
    return collapse(chains.withColumn("coeff", field.times(F.col("coeff"), by if hasattr(by, "_jc") else F.lit(by))), field)


def negate(chains: DataFrame, field=Reals()) -> DataFrame:
    return scale(chains, -1, field)


def minus(a: DataFrame, b: DataFrame, field=Reals()) -> DataFrame:
    return plus(a, negate(b, field), field)


def boundary(chains: DataFrame, field=Reals()) -> DataFrame:
    """The boundary of each chain of simplices."""
    rows = chains.select("chain_id", "coeff", F.explode(terms(F.col("cell"))).alias("t"))
    return collapse(rows.select("chain_id", F.col("t.face").alias("cell"), (F.col("coeff") * F.col("t.coeff")).alias("coeff")), field)


def boundary_by(chains: DataFrame, table: DataFrame, field=Reals()) -> DataFrame:
    """The boundary by a table (cell, face, coeff), for cells of any kind."""
    b = table.select("cell", "face", F.col("coeff").alias("b"))
    rows = chains.join(b, "cell").select("chain_id", F.col("face").alias("cell"), (F.col("coeff") * F.col("b")).alias("coeff"))
    return collapse(rows, field)


Term = tuple[tuple[np.ndarray, ...], int]


def faces_of(terms: list[Term]) -> list[Term]:
    """The boundary of a chain in each row, before equal terms are added: a term is a cell's vertices, an array for each place, and its coefficient."""
    return [(cell[:a] + cell[a + 1 :], c * (-1) ** a) for cell, c in terms if len(cell) > 1 for a in range(len(cell))]


def count_terms(terms: list[Term]) -> int:
    """How many terms the rows' chains have when those of the same cell are added and zeros go."""
    n = len(terms[0][0][0]) if terms else 0
    total = [np.full(n, c, np.int8) for _, c in terms]
    again = [np.zeros(n, bool) for _ in terms]  # an earlier term has that cell
    for b, (cell, c) in enumerate(terms):
        for a, (other, d) in enumerate(terms[:b]):
            if len(other) != len(cell):
                continue
            same = np.ones(n, bool) if not cell else cell[0] == other[0]
            for x, y in zip(cell[1:], other[1:], strict=True):
                same &= x == y
            for x, by in ((total[a], c), (total[b], d)):
                if abs(by) == 1:
                    (np.add if by == 1 else np.subtract)(x, same.view(np.int8), out=x)
                else:
                    x += same.view(np.int8) * np.int8(by)
            again[b] |= same
    return sum(int(np.count_nonzero((t != 0) > x)) for t, x in zip(total, again, strict=True))

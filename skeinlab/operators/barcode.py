"""Maps between barcodes.

A map is a sparse matrix mat(map_id, row, col, x): row a target bar, col a source bar; bars are
tables (map_id, k, lower, upper) with numbers for ends, [lower, upper). Many maps run in one job, dealt out by map_id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlab.functions.fields import Reals

OUT = "map_id long, lower double, upper double"


def is_map(source: DataFrame, target: DataFrame, mat: DataFrame) -> DataFrame:
    """map_id and valid: no non-zero entry goes from a bar to one that starts later, ends later, or is apart from it."""
    s = source.select("map_id", F.col("k").alias("col"), F.col("lower").alias("sl"), F.col("upper").alias("su"))
    t = target.select("map_id", F.col("k").alias("row"), F.col("lower").alias("tl"), F.col("upper").alias("tu"))
    entries = mat.filter("x <> 0").join(s, ["map_id", "col"]).join(t, ["map_id", "row"])
    fine = entries.groupBy("map_id").agg(F.bool_and((F.col("sl") >= F.col("tl")) & (F.col("su") >= F.col("tu")) & (F.col("sl") <= F.col("tu")) & (F.col("su") >= F.col("tl"))).alias("fine"))
    ids = source.select("map_id").union(target.select("map_id")).distinct()
    return ids.join(fine, "map_id", "left").select("map_id", F.coalesce("fine", F.lit(True)).alias("valid"))


def reduce_columns(columns: list[dict[int, float]], field=Reals()) -> list[dict[int, float]]:
    """Left to right; a column's pivot is its last non-zero row, and pivots end up distinct."""
    done: dict[int, dict[int, float]] = {}
    out = []
    for column in columns:
        own = {r: v for r, x in column.items() if (v := field.number(x))}
        while own and (low := max(own)) in done:
            other = done[low]
            factor = -field.quotient(own[low], other[low])
            for r, x in other.items():
                own[r] = field.number(own.get(r, 0) + factor * x)
            own[low] = 0
            own = {r: x for r, x in own.items() if x}
        if own:
            done[max(own)] = own
        out.append(own)
    return out


def pivots(columns: list[dict[int, float]]) -> list[tuple[int, int]]:
    return [(max(c), j) for j, c in enumerate(columns) if c]


def reduce_matrix(mat: DataFrame, field=Reals()) -> DataFrame:
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["col"].max()) + 1
        columns: list[dict] = [{} for _ in range(n)]
        for r in rows.itertuples():
            columns[int(r.col)][int(r.row)] = r.x
        done = [(rows.map_id.iloc[0], i, j, float(x)) for j, c in enumerate(reduce_columns(columns, field)) for i, x in sorted(c.items())]
        return pd.DataFrame(done, columns=["map_id", "row", "col", "x"])

    return mat.select("map_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("x").cast("double").alias("x")).groupBy("map_id").applyInPandas(one, "map_id long, row long, col long, x double")


def pivots_of(mat: DataFrame) -> DataFrame:
    return mat.filter("x <> 0").groupBy("map_id", "col").agg(F.max("row").alias("row"))


def _image(source: list, target: list, m: dict, field) -> list[tuple[float, float]]:
    rows = sorted(range(len(target)), key=lambda t: (target[t][1], t))
    cols = sorted(range(len(source)), key=lambda s: (source[s][0], s))
    place = {t: i for i, t in enumerate(rows)}
    reduced = reduce_columns([{place[t]: m[t, s] for t in rows if m.get((t, s))} for s in cols], field)
    return [(source[cols[j]][0], target[rows[i]][1]) for i, j in pivots(reduced)]


def _cokernel(source: list, target: list, m: dict, field) -> list[tuple[float, float]]:
    rows = sorted(range(len(target)), key=lambda t: (target[t][0], t))
    place = {t: i for i, t in enumerate(rows)}
    relations = [(source[s][0], 0, {place[t]: m[t, s] for t in rows if m.get((t, s))}) for s in range(len(source))]
    relations += [(target[t][1], 1, {place[t]: 1.0}) for t in rows if target[t][1] < float("inf")]
    relations.sort(key=lambda r: (r[0], r[1], sorted(r[2].items())))
    reduced = reduce_columns([r[2] for r in relations], field)
    met = {i: relations[j][0] for i, j in pivots(reduced)}
    return [(target[rows[i]][0], met.get(i, float("inf"))) for i in range(len(rows))]


def _kernel(source: list, target: list, m: dict, field) -> list[tuple[float, float]]:
    turned = {(s, t): x for (t, s), x in m.items()}
    dual = _cokernel([(-u, -low) for low, u in target], [(-u, -low) for low, u in source], turned, field)
    return [(-hi, -lo) for lo, hi in dual]


def _per_map(source: DataFrame, target: DataFrame, mat: DataFrame, kernel, field) -> DataFrame:
    def part(df: DataFrame, kind: int) -> DataFrame:
        return df.select("map_id", F.lit(kind).alias("kind"), F.col("k").cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.col("lower").cast("double").alias("a"), F.col("upper").cast("double").alias("b"))

    entries = mat.select("map_id", F.lit(2).alias("kind"), F.col("row").cast("long").alias("i"), F.col("col").cast("long").alias("j"), F.col("x").cast("double").alias("a"), F.lit(0.0).alias("b"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        s, t, m = (rows[rows.kind == k] for k in range(3))
        si, ti = ({k: n for n, k in enumerate(sorted(x.i))} for x in (s, t))
        bars = [[(r.a, r.b) for r in x.sort_values("i").itertuples()] for x in (s, t)]
        found = kernel(*bars, {(ti[r.i], si[r.j]): r.a for r in m.itertuples()}, field)
        return pd.DataFrame([(rows.map_id.iloc[0], a, b) for a, b in found if a < b], columns=["map_id", "lower", "upper"])

    return part(source, 0).union(part(target, 1)).union(entries).groupBy("map_id").applyInPandas(one, OUT)


def image(source: DataFrame, target: DataFrame, mat: DataFrame, field=Reals()) -> DataFrame:
    """Bars of the image: from a source's birth to the death of its pivot; empty bars go."""
    return _per_map(source, target, mat, _image, field)


def cokernel(source: DataFrame, target: DataFrame, mat: DataFrame, field=Reals()) -> DataFrame:
    """Bars of the cokernel: a target bar lasts until a relation, an image or its own death, has it as pivot."""
    return _per_map(source, target, mat, _cokernel, field)


def kernel(source: DataFrame, target: DataFrame, mat: DataFrame, field=Reals()) -> DataFrame:
    """Bars of the kernel: the cokernel of the dual map, in reversed time."""
    return _per_map(source, target, mat, _kernel, field)

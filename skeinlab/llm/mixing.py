"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens (words) are counted for each cell of source, language and topic. The cells' weights are raked: in turn the
marginal of each dimension is scaled to its target, until a round changes no weight by more than a part of TOLERANCE.
Targets that cannot be met together never come to that; after ROUNDS rounds the weights are returned with
``deviation``, the largest relative distance of any marginal from its target, which every row carries (about 0 where
all targets hold). A cell's ratio of raked to
own tokens, over the largest ratio, is the probability of its documents, so expected tokens have the
target shares in every dimension. No floor holds the probabilities up: a small cell with a large ratio makes all others small. A document is kept if a hash of its doc_id, as a number from 0 to
1, is below it.

Targets: for each dimension a table (value, share) or none; none takes tokens to the power ``temperature``.
A value without a target keeps its own share. Without a topic column the topic is the form of the text (table, short, article, long). Null source,
language or topic: a value of its own. Null or empty text: no tokens; such rows have the
probability of their cell. No tokens at all: every probability is 1. Rows that repeat a doc_id are kept or dropped together
within a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlab.storage import drop_table, write_table

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE, ROUNDS, TOLERANCE, MANY_CELLS = 0.8, 100, 1e-6, 50_000


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    bars = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\|"))
    return F.when(bars >= 3, "table").when(tokens < 150, "short").when(tokens < 600, "article").otherwise("long")


def _named(documents: DataFrame) -> DataFrame:
    """documents with _tokens and the three dimensions as _source, _lang and _topic; no null among them."""
    rows = documents.withColumn("_tokens", n_tokens(F.col("text")))
    topic = F.col("topic").cast("string") if "topic" in documents.columns else topic_of(F.col("text"), F.col("_tokens"))
    return rows.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_topic": F.coalesce(topic, F.lit(""))})


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with w, whose marginals are in the targets' proportions and whose sum is that of tokens, and deviation."""
    now = write_table(cells.withColumn("w", F.col("tokens").cast("double")), "cells")
    total = now.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return now.withColumn("deviation", F.lit(0.0))
    goals = {}
    for d in DIMENSIONS:
        own = now.groupBy(F.col(d).alias("_v")).agg(F.sum("tokens").alias("own")).filter("own > 0")
        given = (targets or {}).get(d)
        if given is None:
            goal = own.select("_v", F.pow("own", F.lit(temperature)).alias("g"))
        else:
            goal = own.join(given.select(F.col("value").cast("string").alias("_t"), F.col("share").cast("double").alias("s")), F.col("_v") == F.col("_t"), "left").select("_v", F.coalesce("s", F.col("own") / total).alias("g"))
        scale = goal.agg(F.sum("g").alias("all"))  # one row
        goals[d] = write_table(goal.join(F.broadcast(scale)).select("_v", (F.col("g") / F.col("all") * total).alias("goal")), f"goal-{d}")
    for _ in range(rounds):
        rows, start = now.withColumn("w0", F.col("w")), now
        for d in DIMENSIONS:
            factor = rows.groupBy(F.col(d).alias("_v")).agg(F.sum("w").alias("sum")).join(goals[d], "_v").select("_v", (F.col("goal") / F.col("sum")).alias("f"))
            rows = rows.join(factor, F.col(d) == F.col("_v"), "left").withColumn("w", F.col("w") * F.coalesce("f", F.lit(1.0))).drop("_v", "f")
        now = write_table(rows, "raked")
        moved = now.agg(F.max(F.abs(F.col("w") - F.col("w0")) / F.greatest(F.col("w0"), F.lit(1e-9)))).first()[0] or 0.0
        drop_table(start)
        path = now._skeinlab_path
        now = now.drop("w0")
        now._skeinlab_path = path
        if moved < tolerance:
            break
    sums = [now.groupBy(F.col(d).alias("_v")).agg(F.sum("w").alias("sum")).join(goals[d], "_v").agg(F.max(F.abs(F.col("sum") / F.col("goal") - 1))).first()[0] or 0.0 for d in DIMENSIONS]
    for goal in goals.values():
        drop_table(goal)
    return now.withColumn("deviation", F.lit(float(max(sums))))


def mix(documents: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, seed: int = 1) -> DataFrame:
    """The rows of documents with tokens, mix_topic, weight (raked over own tokens), probability, kept and deviation; same-named columns are replaced."""
    documents = documents.drop("tokens", "mix_topic", "weight", "probability", "kept", "deviation")
    named = _named(documents)
    cells = named.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens"))
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(1.0))
    raked = rake(cells, targets, temperature).select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), ratio.alias("weight"), "deviation")
    top = raked.agg(F.max("weight"), F.count("*")).first()
    if (top[1] or 0) <= MANY_CELLS:
        raked = F.broadcast(raked)  # the count just made bounds it
    rows = named.join(raked, (F.col("_source") == F.col("_s")) & (F.col("_lang") == F.col("_l")) & (F.col("_topic") == F.col("_t")))
    chance = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rows = rows.withColumn("probability", F.least(F.lit(1.0), F.col("weight") / F.lit(float(top[0] or 1.0))))
    return rows.select(*(F.col(f"`{c}`") for c in documents.columns), F.col("_tokens").alias("tokens"), F.col("_topic").alias("mix_topic"), "weight", "probability", (chance < F.col("probability")).alias("kept"), "deviation")

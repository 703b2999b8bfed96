"""Quality rules with DataFrame functions only: base counts and a distribution-divergence rule.

The rule compares two histograms of each text with those of its language, by Jensen-Shannon distance
(base 2, so 0 to 1): character classes (small letters and signs, capitals, digits, white space, punctuation, symbols), and
the language's common words. A language's reference is the sum over all documents that name it as
``lang``. A text is rejected if its classes are farther than ``most_class``, or farther than ``doubt_class``
while its words are farther than ``doubt_word``. Texts of fewer than ``guard`` words are too short for a histogram and pass. A language without
a list of common words is judged by its character classes alone; a null lang is a language like others.

Null text: the empty text (no words: the base fails). Repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlab.storage import write_table

#: Frequent function words.
COMMON_WORDS = {
    "en": "the of and to in a is that it was for as with be by on an or from this".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au il avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es".split(),
}
SPACE = r"[\x20\x09-\x0D]+"
GUARD, MOST_CLASS, DOUBT_CLASS, DOUBT_WORD = 50, 0.25, 0.13, 0.3
MANY_LANGUAGES = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, k: int = 5) -> Column:
    """Number of words that lie in a run of k words which the array holds twice or more."""

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))

    def places(run: Column) -> Column:
        def twice(s: Column) -> Column:
            return F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]))

        ordered = F.sort_array(F.transform(run, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.sort_array(F.filter(let(ordered, twice), lambda p: p.isNotNull()))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, k).otherwise(F.least(F.lit(k), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x)

    def count(run: Column) -> Column:
        return F.when(F.size(F.array_distinct(run)) == F.size(run), 0).otherwise(let(places(run), cover))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= k, 0).otherwise(let(let(hashes, runs), count))


def _facts(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "")
    vocabulary = sorted({w for words in COMMON_WORDS.values() for w in words})
    lists = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        lists = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(lists)

    def found(common: Column) -> Column:
        return F.transform(F.coalesce(lists, F.array().cast("array<string>")), lambda c: (F.size(common) - F.size(F.array_remove(common, c))).cast("long"))

    common = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(vocabulary))
    rows = rows.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("capitals"),
        F.regexp_count("text", F.lit(r"[0-9]")).cast("long").alias("digits"),
        F.regexp_count("text", F.lit(r"[.,;:!?'\"()-]")).cast("long").alias("punctuation"),
        let(common, found).alias("word_counts"),
    )
    space = F.col("n_chars") - F.col("word_chars")
    small = F.col("word_chars") - F.col("capitals") - F.col("digits") - F.col("punctuation") - F.col("n_symbols")
    total = F.aggregate("word_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(small, "capitals", "digits", space, "punctuation", "n_symbols").alias("classes"),
        F.array_append("word_counts", F.col("n_words") - total).alias("words"),
    )


def jensen_shannon(a: Column, b: Column) -> Column:
    """Distance of two count arrays of the same length; an empty histogram is at distance 0."""

    def share(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), lambda n: F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0))))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(share(a), share(b), lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2))


def _sum_arrays(name: str, n: Column | int) -> list[Column]:
    return [F.sum(F.get(F.col(name), F.lit(i))).alias(f"{name}_{i}") for i in range(n)]


def judge(documents: DataFrame, guard: int = GUARD, most_class: float = MOST_CLASS, doubt_class: float = DOUBT_CLASS, doubt_word: float = DOUBT_WORD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance and word_distance."""
    facts = write_table(_facts(documents), "facts")
    longest = max(map(len, COMMON_WORDS.values())) + 1
    sums = facts.groupBy("lang").agg(*_sum_arrays("classes", 6), *_sum_arrays("words", longest))
    slots = F.filter(F.array(*(F.col(f"words_{i}") for i in range(longest))), lambda x: x.isNotNull())
    reference = write_table(sums.select(F.col("lang").alias("of"), F.array(*(F.col(f"classes_{i}") for i in range(6))).alias("ref_classes"), slots.alias("ref_words")), "reference")
    if reference.count() <= MANY_LANGUAGES:
        reference = F.broadcast(reference)  # the count just made bounds it
    rows = facts.join(reference, F.col("lang").eqNullSafe(F.col("of")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), jensen_shannon(F.col("classes"), F.col("ref_classes")).alias("class_distance"), jensen_shannon(F.col("words"), F.col("ref_words")).alias("word_distance"))
    near = (F.col("n_words") < guard) | ((F.col("class_distance") <= most_class) & ((F.col("class_distance") <= doubt_class) | (F.col("word_distance") <= doubt_word)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance")

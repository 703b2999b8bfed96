"""Queries of this package: each applies one operator, with its production parameters, to its whole table.

They are thin: the operators return texts, spans and scores, and these functions derive the
columns that a query is to return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlab.llm import sql
from skeinlab.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlab.llm.ngram_jaccard import join

    return join(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlab.llm.quality_rules import judge

    return judge(_table(spark, sf_dir, "documents")).withColumns({n: F.round(n, 6) for n in ("class_distance", "word_distance")})


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlab.llm.url_templates import judge

    return judge(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlab.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).drop("text", "n_chars")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlab.llm.substring_dedup import dedup

    return dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlab.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents")).drop("matches")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlab.llm.quality_classifier import score, train

    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train(documents, labels.filter(~held_out()))
    return score(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlab.llm.fingerprints import compare_edited

    return compare_edited(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlab.llm.byte_bpe import encode

    return encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.tiktoken")).drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlab.llm.token_counts import count

    return count(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_quality_rules, op3_license_scan, op4_url_templates, op5_mixing, op6_quality_classifier, op7_substring_dedup, op8_fingerprints, op9_byte_bpe, op10_token_counts)
}
#: The others are no SQL queries (models, tokenizers, fingerprints, spans) or have none yet (op3, op4). tests/llm compares all with brute
#: force, a library or held-out labels.
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL

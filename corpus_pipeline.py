"""The corpus pipeline: documents go through five stages, each of which works on all that the one before kept.

Every function takes (spark, docs, sf_dir). run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's docs. All but the last return the columns of
documents; the last adds the tokens. The stages have no SQL form (a model, a similarity join,
hashed spans, raking, a tokenizer), so ORACLE_SQL is None; tests compare each stage with brute force or the library.

Null doc_id: such rows are scored, kept by the Jaccard stage, not cut, mixed and encoded. Null or empty text: scored as the
empty text, otherwise kept. Rows that repeat doc_id and text: one stays in the Jaccard stage. Other columns pass through; those
named like a stage's own results (n_tokens and the like) are replaced in that stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinlab.llm import byte_bpe, mixing, ngram_jaccard, quality_classifier, substring_dedup
from skeinlab.llm.queries import held_out, tokenizer_file
from skeinlab.shipping import ship
from skeinlab.storage import write_table

KEEP_FROM = 0.7


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Labels that are held out don't train it."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = quality_classifier.train(docs, labels)
    return quality_classifier.score(docs, model, "_score").filter(f"_score >= {KEEP_FROM}").drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the first document stays."""
    ship(spark)
    return ngram_jaccard.keep_one(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of non-first repeated spans go; a document of which nothing is left goes, too. n_chars is that of what is left."""
    ship(spark)
    from pyspark.sql import functions as F

    cut = substring_dedup.dedup(docs)
    cut = cut.filter("n_removed = 0 OR trim(text) <> ''")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in the target proportions of source, language and topic."""
    return mixing.mix(docs).filter("kept").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    ship(spark)
    return byte_bpe.encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), ids=True)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_spans),
    ("mixing", mix),
    ("byte-level BPE", tokenize),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

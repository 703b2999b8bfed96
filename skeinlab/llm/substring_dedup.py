"""Substring dedup over sliding sentence spans.

A sentence ends after a word that ends in ``.``, ``!`` or ``?`` (closing quotes or brackets may follow), at a line
break and at the end of the text. From every sentence a span slides forward and another one backward: the
shortest run of at least ``sentences`` consecutive sentences, from that one on or up to it, that has at least
``min_words`` words. Every span is hashed (its
words, whatever white space parts them), all spans are joined by hash, and each sentence that a
non-first repeated span covers is removed, the white space behind it with it. First is the span
with the least (doc_id, hash of text, place). The join is a minimum by hash, combined before the shuffle, that leaves the first
spans; a text's other spans are the non-first ones. So a span that very many texts share is one row, and no
row for each of its places leaves the shuffle.

That removes the same as spans of every length from these bounds on would: in a repeated run long enough, the span forward from its
first sentence lies within it, and so does the span backward from each sentence that this one doesn't reach.
The bound in words leaves short footers alone that many documents share; with ``min_words`` 0 every run of ``sentences`` counts.

A text shorter than a span has none and stays. Null text: stays null. Rows without doc_id stay and take no part. Rows that repeat
both doc_id and text count as one text, so all are cut alike; a doc_id with several texts has them told apart by their hash.
Other columns pass through; those named n_sentences or n_removed are replaced. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlab.llm import _text as X

SENTENCES, MIN_WORDS = 2, 24
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_CLOSES = np.isin(np.arange(256), [ord(c) for c in "\"')]}"])


def sentences(texts: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (start, end), the words before each sentence, the sentences before each text, and the words before each text."""
    start, end, before = texts.words()
    if not len(start):
        return start, end, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64), before
    last = end - 1
    for _ in range(2):
        last = np.where(_CLOSES[texts.data[last]] & (last > start), last - 1, last)
    breaks = np.append(0, np.cumsum(texts.data == 0x0A))
    gap = np.append(start[1:], len(texts.data))
    stop = _ENDS[texts.data[last]] | (breaks[gap] > breaks[end])
    stop[before[1:][np.diff(before) > 0] - 1] = True
    edge = np.append(0, np.flatnonzero(stop) + 1)
    return start, end, edge, np.searchsorted(edge, before), before


def bounds(edge: np.ndarray, at: np.ndarray, least: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first sentence and end of every span, by text; within a text the order is fixed. A span that is shortest both ways comes once."""
    n = len(edge) - 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    first = np.arange(n)
    of = np.searchsorted(at, first, "right") - 1
    stop = np.maximum(np.searchsorted(edge, edge[:-1] + min_words), first + least)
    back = np.minimum(np.searchsorted(edge, edge[1:] - min_words, "right") - 1, first + 1 - least)
    fits, ends = stop <= at[of + 1], back >= at[of]
    ends[ends] = stop[back[ends]] != first[ends] + 1
    first, stop, of = np.append(first[fits], back[ends]), np.append(stop[fits], first[ends] + 1), np.append(of[fits], of[ends])
    order = np.argsort(of, kind="stable")
    return of[order], first[order], stop[order]


def span_rows(documents: DataFrame, least: int, min_words: int) -> DataFrame:
    """A row for each span: h, doc_id, version (hash of the text) and place (number of the span within its text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version"))
            for lo, hi, texts in X.slices(batch.column("text")):
                start, end, edge, at, _ = sentences(texts)
                of, first, stop = bounds(edge, at, least, min_words)
                h = X.span_hashes(X.span_hashes(X.BYTE_VALUES[texts.data], start, end), edge[first], edge[stop]) if len(of) else np.zeros(0, np.uint64)
                place = np.arange(len(of)) - np.searchsorted(of, of)
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(h)), pa.array(ids[lo:hi][of], pa.int64()), pa.array(versions[lo:hi][of]), pa.array(place.astype(np.int32))], ["h", "doc_id", "version", "place"])

    rows = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), "text")
    return rows.mapInArrow(X.tidy(each), "h long, doc_id long, version long, place int")


def first_places(documents: DataFrame, least: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, version and the places of the spans of each text that are the first of their hash; a text without such a span has no row."""
    first = span_rows(documents, least, min_words).groupBy("h").agg(F.min(F.struct("doc_id", "version", "place")).alias("first"))
    return first.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version")).agg(F.collect_list("first.place").alias("places"))


def dedup(documents: DataFrame, least: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of documents with text cut, n_sentences and n_removed; other columns pass through.

    A row's removals are bounded by its own sentences, so gathering them by row is bounded too.
    """
    documents = documents.drop("n_sentences", "n_removed")
    names = documents.columns
    found = first_places(documents, least, min_words).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("places").alias("_places"))
    joined = documents.join(found, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left")
    rows = joined.select(*(F.col(f"`{n}`") for n in names), (F.col("doc_id").isNotNull()).alias("_counts"), "_places")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, counts, text_column = batch.column("_places"), batch.column("_counts"), batch.column("text")
            texts_out, total, removed = [], [], []
            for lo, hi, texts in X.slices(text_column):
                start, _, edge, at, _ = sentences(texts)
                of, first, stop = bounds(edge, at, least, min_words)
                own = np.searchsorted(of, np.arange(hi - lo + 1))
                data = texts.data.tobytes()
                for i in range(hi - lo):
                    n = int(at[i + 1] - at[i])
                    later = np.full(own[i + 1] - own[i], counts[lo + i].as_py())
                    if firsts[lo + i].is_valid:
                        later[firsts[lo + i].values.to_numpy()] = False
                    drop = np.zeros(n + 1, np.int64)
                    np.add.at(drop, first[own[i] : own[i + 1]][later] - at[i], 1)
                    np.add.at(drop, stop[own[i] : own[i + 1]][later] - at[i], -1)
                    gone = np.cumsum(drop[:n]) > 0
                    total.append(n)
                    removed.append(int(gone.sum()))
                    if not text_column[lo + i].is_valid:
                        texts_out.append(None)
                    elif not gone.any():
                        texts_out.append(texts.bytes(i).decode())
                    else:
                        words = edge[at[i] : at[i + 1] + 1]
                        cut = np.append(start[words[:-1]], texts.bounds[i + 1])
                        kept = [data[texts.bounds[i] : cut[0]], *(data[cut[k] : cut[k + 1]] for k in range(n) if not gone[k])]
                        texts_out.append(b"".join(kept).decode())
            columns = [pa.array(texts_out, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_sentences", "n_removed"])

    return rows.mapInArrow(X.tidy(each), T.StructType([*documents.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]))

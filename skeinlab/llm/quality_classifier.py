"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal.

Features of a text, each hashed into ``2**BITS`` weights: its words and word pairs in lower case, the
shapes of its words and pairs of them (a run of letters, capitals or digits is one sign, other
signs stand for themselves), and a sign for a word that repeats the one before it. A feature's
value is its share of the text's features times ``SCALE``. A text is scored as the sparse dot
product of these values and the weights.

Training takes at most ``max_rows`` labelled rows (those with the smallest hash of doc_id) and
visits them one by one in a fixed order; its model has a fixed size. Every row is scored.
Null text: scored as the empty text (the intercept alone). Repeated rows are scored each; of the texts of one doc_id
the least trains. Labels that are null, or that share a doc_id with another label, don't train. No labels: every score is 0.5. Columns of the
input other than doc_id and text are never read by the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlab.llm import _text as X

BITS, SCALE = 20, 20.0
_SHAPE = np.arange(256)
_SHAPE[ord("a") : ord("z") + 1] = _SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE_VALUES = X.BYTE_VALUES[_SHAPE]


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    intercept: float = 0.0


def features(texts: X.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Index of every feature occurrence, text by text, and the occurrences before each text."""
    start, end, before = texts.words()
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    word = X.span_hashes(X.LOWER_BYTE_VALUES[texts.data], start, end)
    sign = _SHAPE[texts.data]
    keep = np.ones(len(sign), bool)
    keep[1:] = sign[1:] != sign[:-1]
    keep[start] = True
    place = np.append(0, np.cumsum(keep))
    shape = X.span_hashes(_SHAPE_VALUES[texts.data[keep]], place[start], place[end])
    opens = np.zeros(n, bool)
    opens[before[:-1][np.diff(before) > 0]] = True

    def pairs(h: np.ndarray, salt: int) -> np.ndarray:
        previous = np.roll(h, 1)
        previous[opens] = np.uint64(salt)
        return X.mix64(previous * np.uint64(0xC2B2AE3D27D4EB4F) + h + np.uint64(salt))

    same = (word == np.roll(word, 1)) & ~opens
    each = np.empty((n, 5), np.uint64)
    each[:, 0], each[:, 1], each[:, 2], each[:, 3] = word, pairs(word, 1), shape ^ np.uint64(0x5555), pairs(shape, 2)
    each[:, 4] = np.where(same, np.uint64(7), np.uint64(11))
    index = (X.mix64(each.ravel()) >> np.uint64(64 - BITS)).astype(np.int64)
    return index, before * 5


def dot(model: Model, texts: X.Texts) -> np.ndarray:
    index, before = features(texts)
    total = np.append(0.0, np.cumsum(model.weights[index], dtype=np.float64))
    n = np.diff(before)
    z = model.intercept + SCALE * (total[before[1:]] - total[before[:-1]]) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, _, texts in X.slices(batch.column("text")):
            index, before = features(texts)
            for i in range(len(texts)):
                at, count = np.unique(index[before[i] : before[i + 1]], return_counts=True)
                share = (count / max(1, count.sum()) * SCALE).astype(np.float32)
                rows.append((at.astype(np.int32).tobytes(), share.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.binary())], ["doc_id", "label", "at", "share"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> Model:
    """FTRL-proximal: one step for each row and epoch, with a rate of its own for each weight."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    last = np.array([1 << BITS])

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, last), np.append(x, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange((1 << BITS) + 1))
    return Model(every[:-1].astype(np.float32), float(every[-1]))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 6000, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model:
    """Fit on the rows of labels (doc_id and a column of 0 and 1). max_rows bounds what is gathered to fit."""
    one = labels.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
    chosen = one.filter("doc_id IS NOT NULL AND label = other AND label IN (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    bounded = F.broadcast(chosen.select("doc_id", F.col("label").cast("int").alias("label")))  # max_rows rows of two numbers
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(bounded, "doc_id").select("doc_id", "label", "text")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one text for each label, so max_rows bounds what is gathered
    found = rows.mapInArrow(X.tidy(_sparse), "doc_id long, label int, at binary, share binary").toArrow().sort_by("doc_id")
    labelled, at, share = (found.column(n) for n in ("label", "at", "share"))
    model = ftrl([(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float32), y.as_py()) for a, x, y in zip(at, share, labelled, strict=True)], epochs, alpha, beta, l1, l2)
    del found, labelled, at, share
    X.release_memory()
    return model


def score(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The rows and columns of documents with a column more (an input column of that name is replaced)."""
    documents = documents.drop(column)
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # 4 MB, whatever the input

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            scores = [dot(own, texts) for _, _, texts in X.slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*batch.schema.names, column])

    return documents.mapInArrow(X.tidy(each), T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())]))

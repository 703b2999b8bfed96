"""Document fingerprints by closed syncmers.

A window of K bytes is an anchor if the smallest of its inner windows of S bytes (by a 32-bit hash) is its
first or its last one. That depends on the window alone, so a text that holds a passage holds the
passage's anchors too. A fingerprint keeps every anchor and its place, in the order of the text, so its size
is in proportion to the text's. Two fingerprints are compared by position: of the anchors of their union (an anchor
as often as in the text that has it more often), those that both have and whose places rise in both (a
longest chain) are counted; that share is the likeness. Two empty texts: 1. An empty and another text: 0.

A text of fewer than K bytes has one anchor, itself. A null text is an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlab.llm import _text as X

K, S = 16, 6
#: Rows and characters that are worked on at once.
ROWS, CHARS = 256, 1 << 22


def anchors(texts: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place in its text of each closed syncmer, and the anchors before each text."""
    data = np.concatenate([texts.data, np.zeros(K, np.uint8)]).astype(np.uint64)
    two = data[:-1] | data[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    inner = (X.mix64(four[: len(four) - 2] | two[4 : len(four) + 2] << np.uint64(32)) >> np.uint64(32)).astype(np.uint32)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(texts.data)
    low = inner[: n + 10]
    span = K - S + 1
    least, width = low, 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    m = max(0, n - K + 1)
    smallest = np.minimum(least[:m], least[span - width : span - width + m])
    chosen = np.flatnonzero((low[:m] == smallest) | (low[span - 1 : span - 1 + m] == smallest))
    of = np.searchsorted(texts.bounds, chosen, "right") - 1
    inside = chosen + K <= texts.bounds[of + 1]
    chosen, of = chosen[inside], of[inside]
    hashes = (X.mix64(eight[chosen] * np.uint64(0x9E3779B97F4A7C15) + X.mix64(eight[chosen + 8])) >> np.uint64(32)).astype(np.uint32)
    return hashes, chosen - texts.bounds[of], np.searchsorted(of, np.arange(len(texts) + 1))


def prints(rows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    column = pa.array(rows, pa.large_binary())
    for _, _, texts in X.slices(column):
        hashes, places, before = anchors(texts)
        for i in range(len(texts)):
            if before[i] < before[i + 1]:
                out.append((hashes[before[i] : before[i + 1]], places[before[i] : before[i + 1]]))
            else:
                whole = texts.bytes(i)
                out.append((np.frombuffer(hashlib.sha256(whole).digest()[:4], np.uint32)[: len(whole)], np.zeros(min(1, len(whole)), np.int64)))
    return out


def write(fp: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of the hashes and then the places, as little-endian 32-bit words."""
    return base64.b64encode(fp[0].astype("<u4").tobytes() + fp[1].astype("<u4").tobytes()).decode()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    x, y = a[0], b[0]
    n = min(len(x), len(y))
    head = int(np.append(x[:n] != y[:n], True).argmax())
    n -= head
    tail = int(np.append(True, x[len(x) - n :] != y[len(y) - n :])[::-1].argmax())
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    own, other = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    shared, i, j = np.intersect1d(own[0], other[0], assume_unique=True, return_indices=True)
    union = head + tail + len(x) + len(y) - int(np.minimum(own[1][i], other[1][j]).sum())
    return (head + tail + _chain(x[np.isin(x, shared)].tolist(), y[np.isin(y, shared)].tolist())) / union


def _chain(x: list[int], y: list[int]) -> int:
    """Length of a longest common subsequence, a row of its table in the bits of one number."""
    if len(x) > len(y):
        x, y = y, x
    where: dict[int, int] = {}
    for i, h in enumerate(x):
        where[h] = where.get(h, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for h in y:
        met = row & where[h]
        row = (row + met | row - met) & full
    return len(x) - row.bit_count()


def _parts(rows: list, chars: Callable[[object], int]) -> Iterator[list]:
    """Runs of rows of at most ROWS rows and about CHARS characters, or one longer row."""
    part, held = [], 0
    for row in rows:
        if part and (len(part) == ROWS or held + chars(row) > CHARS):
            yield part
            part, held = [], 0
        part.append(row)
        held += chars(row)
    if part:
        yield part


def fingerprint(documents: DataFrame, column: str = "fingerprint") -> DataFrame:
    """doc_id and the fingerprint of each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
            for part in _parts(rows, lambda r: len(r[1] or "")):
                own = prints([(t or "").encode() for _, t in part])
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array(map(write, own), pa.string())], ["doc_id", column])

    return documents.select("doc_id", "text").mapInArrow(X.tidy(each), f"doc_id long, `{column}` string")


def _bucket(order: Column, bounds: list[int]) -> Column:
    """Number of ascending bounds that are at most order, by two short scans."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every, coarse = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[step - 1 :: step]))
    block = F.size(F.filter(coarse, lambda b: b <= order))
    return block * step + F.size(F.filter(F.slice(every, block * step + 1, step), lambda b: b <= order))


def compare_edited(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form, and how alike they and the next text's are.

    Edited: the last floor(n_chars / 4) code points give way to the first as many of the next row's text by
    (doc_id, text), nulls first; the last row's next is the first. Rows are dealt out by ranges of
    doc_id; the first rows of each range are also sent, as look-ahead, to the range before it, so no
    task needs another's rows. Rows that repeat a doc_id stay in one range.
    """
    spark = documents.sparkSession
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = documents.select("doc_id", order.alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ids = documents.select("doc_id")
    cuts = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = sorted({int(c) for c in cuts})
    bucket = _bucket(F.col("ord"), bounds)
    firsts = sorted((r["b"], r["o"]) for r in ids.select(order.alias("ord")).select(bucket.alias("b"), "ord").groupBy("b").agg(F.min("ord").alias("o")).collect())  # a row for each range
    before = {o: firsts[i - 1][0] for i, (_, o) in enumerate(firsts)}
    target = F.lit(None).cast("int")
    if before:
        target = F.when(F.col("ord").isin(list(before)), F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("ord")))
    own = F.struct(bucket.cast("int").alias("b"), F.lit(False).alias("ahead"))
    ahead = F.struct(target.cast("int").alias("b"), F.lit(True).alias("ahead"))
    dealt = rows.select("doc_id", "ord", "text", F.explode(F.when(target.isNull(), F.array(own)).otherwise(F.array(own, ahead))).alias("to"))
    dealt = dealt.select("doc_id", "ord", "text", "to.b", "to.ahead").repartitionById(max(1, len(bounds) + 1), F.col("b")).sortWithinPartitions("b", "ahead", "ord", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row whose next one isn't read yet

        def judged(pairs: list[tuple]) -> pa.RecordBatch:
            texts, edited = [], []
            for _, text, after in pairs:
                q = len(text) // 4
                texts.append(text.encode())
                edited.append((text[: len(text) - q] + after[:q]).encode())
            fps, efps = prints(texts), prints(edited)
            nexts = [*fps[1:], *prints([pairs[-1][2].encode()])] if pairs else []
            for i in range(len(pairs) - 1):
                if pairs[i][2] is not pairs[i + 1][1]:
                    nexts[i] = prints([pairs[i][2].encode()])[0]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array([write(f) for f in fps], pa.string()), pa.array([write(f) for f in efps], pa.string()), pa.array([likeness(*x) for x in zip(fps, efps, strict=True)], pa.float64()), pa.array([likeness(*x) for x in zip(fps, nexts, strict=True)], pa.float64())], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            pairs = []
            for doc, text, b, is_ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "b", "ahead")), strict=True):
                if waiting is not None and waiting[2] == b:
                    pairs.append((waiting[0], waiting[1], text))
                    waiting = None
                if not is_ahead:
                    waiting = (doc, text, b)
            yield from map(judged, _parts(pairs, lambda p: len(p[1])))

    return dealt.select("doc_id", "text", "b", "ahead").mapInArrow(X.tidy(each), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition.

The ranks file gives token bytes and ids. A merge table holds, for each token and each way to cut
it into two tokens, the pair and its rank. Within a partition the texts are cut into pre-tokens by
the tokenizer's pattern; the distinct pre-tokens become token-position rows, and a recursive query
joins them with the merge table and contracts each word's leftmost pair of least rank until none
is left. A pre-token that is a token as a whole is left as it is, as the tiktoken library does. An ordered
aggregation over the positions gives the ids and, by the token table, the decoded bytes.

One step of the recursion contracts all places of a word's least pair from left to right, as far as that is the same
as one after the other: up to the first place where the new token and a neighbour make a pair of lower
rank. Then a word takes about a step for each rank, not for each place, and
one sign repeated n times takes log n steps. Words of up to PLAIN bytes take the leftmost place alone, which is cheaper
for them and gives the same. Letters, numbers and white space are what tiktoken's own
pattern engine takes for them.

Memory: a slice of texts (a long text comes in parts), symbols of BYTES bytes of words or of one longer word, and a
table of distinct short words that keeps those of the last WORDS to twice as many. Null text: the empty text (no tokens). Repeated rows are encoded
each. Other columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skeinlab.llm import _text as X
from skeinlab.llm._files import send_file, sent_file

BYTES, WORDS, SHORT, PLAIN = 1 << 18, 100_000, 64, 32


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(1)
def classes() -> np.ndarray:
    """X.class_table() of the library, asked by encoding every code point with a pattern that drops all but one class."""
    import tiktoken

    signs = {bytes([b]): b for b in range(256)}
    return X.class_table(*(bytes(tiktoken.Encoding("class", pat_str=p, mergeable_ranks=signs, special_tokens={}).encode_ordinary(X.ALL_POINTS)).decode() for p in (r"\p{L}", r"\p{N}", r"\s")))


def pre_tokens(texts: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each match of public_tokenizers.PATTERN, and the matches before each text.

    The pattern's matches are runs of letters, numbers or other signs with one blank before them,
    white space except its last sign before such a run, and English contractions where an
    apostrophe alone starts a match.
    """
    points, bounds, place = X.code_points(texts)
    kinds = classes()[points]
    start, end = X.runs(kinds, bounds)
    if not len(start):
        return start, end, np.zeros(len(texts) + 1, np.int64)
    kind = kinds[start]
    opens = np.isin(start, bounds)  # the first run of its text
    closes = np.isin(end, bounds)
    space = kind == 3
    blank = np.zeros(len(start), bool)  # a blank right before this run, in the same text
    blank[1:] = ~opens[1:] & (points[start[1:] - 1] == 0x20)
    begin = np.zeros(len(points) + 1, bool)
    begin[start[~space & ~blank]] = True
    begin[start[space]] = True
    begin[end[space & ~closes] - 1] = True
    alone = np.flatnonzero((kind == 0) & (end - start == 1) & (points[start] == 0x27) & ~blank & ~closes)
    alone = alone[kind[alone + 1] == 1]
    size = X.contraction_lengths(points, start[alone])
    fits = (size > 0) & (size <= end[alone + 1] - start[alone + 1])
    alone, size = alone[fits], size[fits]
    begin[start[alone + 1]] = False
    rest = start[alone + 1] + size
    begin[rest[rest < end[alone + 1]]] = True
    begin[-1] = False
    at = np.flatnonzero(begin)
    return place[at], np.append(place[at[1:]], len(texts.data)), np.searchsorted(at, bounds)


#: The leftmost place of each word's least pair; enough for short words, and cheaper.
_LEFTMOST = """
WITH RECURSIVE step AS (
  SELECT w, g, nx, t, false AS done FROM symbols
  UNION ALL
  (WITH now AS MATERIALIZED (SELECT w, g, nx, t FROM step WHERE NOT done),
    best AS MATERIALIZED (
      SELECT a.w, arg_min({'g': a.g, 'gone': b.g, 'nx': b.nx, 'r': m.r}, m.r::BIGINT * 4294967296 + a.g) AS x
      FROM now a JOIN now b ON a.nx = b.g JOIN merges m ON m.a = a.t AND m.b = b.t GROUP BY a.w)
  SELECT c.w, c.g, CASE WHEN c.g = x.g THEN x.nx ELSE c.nx END, CASE WHEN c.g = x.g THEN x.r ELSE c.t END, x IS NULL
  FROM now c LEFT JOIN best USING (w) WHERE x IS NULL OR c.g <> x.gone)
)"""
#: All places that may be contracted at once.
_ALL_PLACES = """
WITH RECURSIVE step AS (
  SELECT w, g, nx, t, false AS done FROM symbols
  UNION ALL
  (WITH now AS MATERIALIZED (SELECT w, g, nx, t FROM step WHERE NOT done),
    pairs AS MATERIALIZED (
      SELECT a.w, a.g, b.g AS gone, b.nx, m.r, m.risk
      FROM now a JOIN now b ON a.nx = b.g JOIN merges m ON m.a = a.t AND m.b = b.t),
    best AS MATERIALIZED (SELECT w, min(r) AS r FROM pairs GROUP BY w),
    least AS MATERIALIZED (
      SELECT p.w, p.g, p.gone, p.nx, p.r, p.risk, row_number() OVER (ORDER BY p.g) AS i, lag(p.gone) OVER (ORDER BY p.g) IS DISTINCT FROM p.g AS head
      FROM pairs p JOIN best ON p.w = best.w AND p.r = best.r),
    odd AS MATERIALIZED (SELECT * FROM (SELECT *, i - max(CASE WHEN head THEN i END) OVER (ORDER BY g) AS place FROM least) WHERE place % 2 = 0),
    low AS (
      SELECT o.w, o.g FROM odd o JOIN now n ON n.g = o.nx JOIN early e ON e.x = o.r AND e.side = 1 AND e.y = n.t WHERE o.risk
      UNION ALL SELECT o.w, o.g FROM odd o JOIN now p ON p.nx = o.g JOIN early e ON e.x = o.r AND e.side = -1 AND e.y = p.t WHERE o.risk
      UNION ALL SELECT o.w, o.g FROM odd o JOIN odd n ON n.g = o.nx JOIN early e ON e.x = o.r AND e.y = o.r WHERE o.risk),
    chosen AS MATERIALIZED (
      SELECT o.g, o.gone, o.nx, o.r FROM odd o LEFT JOIN (SELECT w, min(g) AS g FROM low GROUP BY w) l ON l.w = o.w WHERE l.g IS NULL OR o.g <= l.g)
  SELECT c.w, c.g, coalesce(x.nx, c.nx), coalesce(x.r, c.t), best.w IS NULL
  FROM now c LEFT JOIN best ON best.w = c.w LEFT JOIN chosen x ON x.g = c.g
  WHERE c.g NOT IN (SELECT gone FROM chosen))
)"""
_RESULT = """
SELECT w, count(*), string_agg(t::VARCHAR, ' ' ORDER BY g), string_agg(hex, '' ORDER BY g)
FROM step JOIN vocabulary USING (t) WHERE done GROUP BY w"""


class Encoder:
    """The tables of one tokenizer and, from open() to close(), an in-memory DuckDB of one thread that holds them."""

    _held: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        self.table = ranks(path)
        cut = [(self.table[t[:i]], self.table[t[i:]], rank) for t, rank in self.table.items() for i in range(1, len(t)) if t[:i] in self.table and t[i:] in self.table]
        early = [(x, side, y) for a, b, rank in cut for x, side, y in ((a, 1, b), (b, -1, a)) if x > rank]  # x with y at that side makes a token of lower rank
        risks = {x for x, _, _ in early}
        left, right, rank = (pa.array(x, pa.int32()) for x in zip(*cut, strict=True))
        self.merges = pa.table({"a": left, "b": right, "r": rank, "risk": pa.array([r in risks for _, _, r in cut])})
        self.early = pa.table({"x": pa.array([x for x, _, _ in early], pa.int32()), "side": pa.array([x for _, x, _ in early], pa.int8()), "y": pa.array([y for _, _, y in early], pa.int32())})
        self.vocabulary = pa.table({"t": pa.array(self.table.values(), pa.int32()), "hex": pa.array([t.hex() for t in self.table])})
        self.db = None
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.before: dict[bytes, tuple[int, bytes, bytes]] = {}  # the table before it was full
        self.first = np.array([self.table[bytes([b])] for b in range(256)], np.int32)

    def open(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "allocator_flush_threshold": "1MB"})
        for name in ("merges", "early", "vocabulary"):
            self.db.register("own", getattr(self, name))
            self.db.execute(f"CREATE TABLE {name} AS SELECT DISTINCT * FROM own")
            self.db.unregister("own")

    def close(self) -> None:
        self.db.close()
        self.db = None

    def lookup(self, words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Number of ids, ids in decimal joined by a space, and decoded bytes of each word."""
        get, before, late = self.known.get, self.before.get, []
        out = list(map(get, words))
        for i in [i for i, v in enumerate(out) if v is None]:
            w = words[i]
            v = get(w) or before(w)
            if v is None:
                late.append(i)
            else:
                out[i] = self.known[w] = v
        if late:
            new = list(dict.fromkeys(words[i] for i in late))
            found = dict(zip(new, self.words(new), strict=True))
            for i in late:
                out[i] = found[words[i]]
            self.known.update((w, v) for w, v in found.items() if len(w) <= SHORT)
        if len(self.known) > WORDS:
            self.known, self.before = {}, self.known
        return out

    def words(self, words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """The same of distinct words, encoded in chunks of words of about one length."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        size = np.append(0, np.cumsum([len(words[i]) for i in order]))
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + BYTES, "right")) - 1)
            self._recursive(words, order[lo:hi], out)
            lo = hi
        return out

    def _recursive(self, words: list[bytes], which: list[int], out: list) -> None:
        chosen = [words[i] for i in which]
        whole = np.array([self.table.get(w, -1) for w in chosen], np.int32)
        of = np.repeat(np.arange(len(chosen), dtype=np.int32), [len(w) for w in chosen])
        token = self.first[np.frombuffer(b"".join(chosen), np.uint8)]
        opens = np.append(True, of[1:] != of[:-1])[: len(of)]
        token = np.where(whole[of] >= 0, whole[of], token)
        keep = opens | (whole[of] < 0)
        of, token = of[keep], token[keep]
        g = np.arange(len(of), dtype=np.int32)
        after = np.where(np.append(of[1:], -1) == of, g + 1, -1).astype(np.int32)
        self.db.register("symbols", pa.table({"w": of, "g": g, "nx": after, "t": token}))
        rows = self.db.execute((_LEFTMOST if len(chosen[-1]) <= PLAIN else _ALL_PLACES) + _RESULT).fetchall()
        self.db.unregister("symbols")
        for i, n, ids, text in rows:
            decoded = bytes.fromhex(text)
            out[which[i]] = (n, ids.encode(), words[which[i]] if words[which[i]] == decoded else decoded)  # one object for both


def forget() -> None:
    """Drop the tables and words that a worker keeps between the tasks of this kernel."""
    Encoder._held.clear()
    ranks.cache_clear()


RESULT = {"n_tokens": "long", "token_ids": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(documents: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """The rows of documents with n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids (decimal, joined by a space)."""
    names = [n for n in RESULT if ids or n != "token_ids"]
    documents = documents.drop(*names)

    name = send_file(documents.sparkSession, path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(sent_file(name))  # it and its table of words outlive the task, until the worker begins another kernel
        encoder.open()
        try:
            for batch in batches:
                for lo, hi, texts in X.slices(batch.column("text")):
                    yield encoded(encoder, batch.slice(lo, hi - lo), texts)
        finally:
            encoder.close()

    def encoded(encoder: Encoder, rows: pa.RecordBatch, texts: X.Texts) -> pa.RecordBatch:
        values: list[tuple[int, bytes, bytes]] = []
        sizes = []
        for part in X.chunks(texts):
            start, end, before = pre_tokens(part)
            raw = part.data.tobytes()
            values += encoder.lookup([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            sizes.append(np.diff(before))
        before = np.append(0, np.cumsum(sizes[0] if len(sizes) == 1 else [np.concatenate(sizes).sum()]))
        got: list[tuple] = []
        for i in range(len(texts)):
            own = values[before[i] : before[i + 1]]
            text = b" ".join([v[1] for v in own])
            got.append((sum([v[0] for v in own]), text.decode() if ids else None, hashlib.sha256(text).hexdigest(), hashlib.sha256(b"".join([v[2] for v in own])).hexdigest()))
        columns = dict(zip(RESULT, zip(*got, strict=True), strict=True))
        arrow = {"long": pa.int64(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(columns[n], arrow[RESULT[n]]) for n in names)], [*rows.schema.names, *names])

    kinds = {"long": T.LongType(), "string": T.StringType()}
    return documents.mapInArrow(X.tidy(each, forget), T.StructType([*documents.schema.fields, *(T.StructField(n, kinds[RESULT[n]]) for n in names)]))

r"""Token counts by the whole-token shortcut.

Once, on the driver: every string of the vocabulary that closes a word is encoded alone, and those that
give one token are proved whole. At run time texts are normalised and cut into pre-tokens as the
tokenizer does it; a pre-token among the proved ones counts one, and only the others are merged
(each distinct one once for as long as the table of words holds it).

Covers tokenizers of the kind of ``word_bpe_49k.json``: NFC, lower case, the pattern
``'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+`` and BPE with a mark at word ends. What a letter, number or white space is
and the lower case of each code point are asked of the library, once. A text is normalised by the library itself if it has
a code point that may join another one (a mark, a second part of a composition), that no table knows, or
whose form is not one code point. Pieces are merged by the library's model alone, without its normaliser. Special strings within
a text count one token each and part the text there, as the library has it by default.

Null text: the empty text (0 bytes, 0 tokens). Repeated rows are counted each. Other columns pass
through; those named like a result are replaced. Memory: a slice of texts (a long text comes in parts, but for one that the
library normalises) and a table of WORDS words.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skeinlab.llm import _text as X
from skeinlab.llm._files import send_file, sent_file

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS, SHORT = 200_000, 64


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def class_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """X.class_table() of the library, and the lower case of each code point (0: the library has to normalise the text)."""
    from tokenizers import Regex, pre_tokenizers

    def having(pattern: str) -> str:
        rest = pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(X.ALL_POINTS)
        kept = np.ones(len(X.ALL_POINTS), bool)
        for _, (a, b) in rest:
            kept[a:b] = False
        return "".join(X.ALL_POINTS[i] for i in np.flatnonzero(kept))

    classes = X.class_table(*map(having, (r"\p{L}", r"\p{N}", r"\s")))
    others = X.ALL_POINTS.replace("|", "")
    forms = tokenizer(path).normalizer.normalize_str("|".join(others)).split("|")
    if len(forms) != len(others):
        raise ValueError("this tokenizer normalises texts in another way")
    lower = np.zeros(len(classes), np.uint32)
    lower[ord("|")] = ord("|")
    for c, form in zip(others, forms, strict=True):
        if len(form) == 1 and not unicodedata.combining(c) and unicodedata.category(c) not in ("Cn", "Mn", "Mc", "Me"):
            lower[ord(c)] = ord(form)
    for c in others:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            lower[int(parts[1], 16)] = 0
    lower[0x1160:0x1200] = 0  # Hangul vowels and finals, which join the sign before them by a rule
    return classes, lower


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in the vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    return dict(zip([*printable, *sorted({*range(256)} - {*printable})], [*map(chr, printable), *map(chr, range(256, 256 + 256 - len(printable)))], strict=True))


def prove_whole(path: str) -> list[str]:
    """The vocabulary strings that the library encodes, alone, as one token."""
    spec = json.loads(open(path, encoding="utf-8").read())
    if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
        raise ValueError("this tokenizer cuts texts in another way")
    own, end = tokenizer(path), spec["model"]["end_of_word_suffix"]
    of_sign = {s: b for b, s in byte_signs().items()}
    words = []
    for token in spec["model"]["vocab"]:
        if token.endswith(end) and len(token) > len(end):
            try:
                words.append(bytes(of_sign[c] for c in token[: -len(end)]).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    return [w for w, e in zip(words, own.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1 and own.normalizer.normalize_str(w) == w]


def cut(points: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each pre-token of normalised texts, and the pre-tokens before each text."""
    kinds = classes[points]
    start, end = X.runs(kinds, bounds)
    if not len(start):
        return start, end, np.zeros(len(bounds), np.int64)
    kind, closes = kinds[start], np.isin(end, bounds)
    begin = kinds == 2
    begin[start[kind != 3]] = True
    alone = np.flatnonzero((kind == 0) & (end - start == 1) & (points[start] == 0x27) & ~closes)
    alone = alone[kind[alone + 1] == 1]
    size = X.contraction_lengths(points, start[alone])
    fits = (size > 0) & (size <= end[alone + 1] - start[alone + 1])
    alone, size = alone[fits], size[fits]
    begin[start[alone + 1]] = False
    rest = start[alone + 1] + size
    begin[rest[rest < end[alone + 1]]] = True
    stop = np.append(begin[1:], True)  # a pre-token ends before the next one or before white space
    stop[:-1] |= (kinds[1:] == 3) & (kinds[:-1] != 3)
    stop &= kinds != 3
    inner = bounds[(bounds > 0) & (bounds < len(points))]
    stop[inner - 1] |= kinds[inner - 1] != 3
    first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return first, last, np.searchsorted(first, bounds)


class Counter:
    """Tokens of texts, for one tokenizer. whole: strings proved to be one token."""

    def __init__(self, path: str, classes: np.ndarray, lower: np.ndarray, whole: list[str]):
        self.own, self.classes, self.lower = tokenizer(path), classes, lower
        self.whole, self.known = dict.fromkeys(whole, 1), {}
        self.signs = str.maketrans({chr(b): s for b, s in byte_signs().items()})
        special = [t["content"] for t in json.loads(open(path, encoding="utf-8").read())["added_tokens"]]
        self.parts = re.compile("|".join(map(re.escape, special))) if special else None

    def merge(self, word: str) -> int:
        return len(self.own.model.tokenize(word.encode().decode("latin-1").translate(self.signs)))

    def normalised(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the texts in the library's form, and their bounds."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        low = self.lower[points]
        asked = np.flatnonzero(low == 0)
        if not len(asked):
            return low, bounds
        rows = np.unique(np.searchsorted(bounds, asked, "right") - 1)
        out = [low[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in rows.tolist():
            out[i] = np.frombuffer(self.own.normalizer.normalize_str(texts[i]).encode("utf-32-le"), np.uint32)
        return np.concatenate(out), np.append(0, np.cumsum([len(x) for x in out])).astype(np.int64)

    def plain(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts without special strings."""
        points, bounds = self.normalised(texts)
        first, last, before = cut(points, bounds, self.classes)
        text = points.tobytes().decode("utf-32-le")
        words = [text[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        counts = list(map(self.whole.get, words))
        for i in [i for i, n in enumerate(counts) if n is None]:
            n = self.known.get(words[i])
            if n is None:
                n = self.merge(words[i])
                if len(words[i]) <= SHORT:
                    if len(self.known) >= WORDS:
                        self.known.clear()
                    self.known[words[i]] = n
            counts[i] = n
        total = np.append(0, np.cumsum(np.array(counts, np.int64)))
        return total[before[1:]] - total[before[:-1]]

    def __call__(self, texts: X.Texts) -> np.ndarray:
        whole_text = texts.data.tobytes().decode("utf-8")
        ends = np.append(0, np.cumsum(texts.char_counts())).tolist()
        rows = [whole_text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if not self.parts or not self.parts.search(whole_text):
            return self.plain(rows)
        cut_rows = [self.parts.split(r) for r in rows]
        of = np.repeat(np.arange(len(rows)), [len(c) for c in cut_rows])
        got = self.plain([x for c in cut_rows for x in c])
        return np.bincount(of, got, len(rows)).astype(np.int64) + np.array([len(c) - 1 for c in cut_rows])


_counters: dict[str, Counter] = {}


def count(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """The rows of documents with n_bytes, n_tokens and over_limit (more tokens than limit)."""
    names = ["n_bytes", "n_tokens", "over_limit"]
    documents = documents.drop(*names)
    name = send_file(documents.sparkSession, path)
    facts = documents.sparkSession.sparkContext.broadcast((*class_tables(path), prove_whole(path)))  # a table of code points, and a part of the vocabulary

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = sent_file(name)
        if file not in _counters:
            _counters[file] = Counter(file, *facts.value)
        counter = _counters[file]
        for batch in batches:
            sizes, counts = [], []
            for _, _, texts in X.slices(batch.column("text")):
                sizes.append(np.diff(texts.bounds))
                parts = [counter(part) for part in X.chunks(texts)]
                counts.append(parts[0] if len(parts) == 1 else np.sum(parts, axis=0))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            size = np.concatenate(sizes) if sizes else n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [*batch.schema.names, *names])

    return documents.mapInArrow(X.tidy(each), T.StructType([*documents.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]))

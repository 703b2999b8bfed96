"""Array kernels over whole texts, shared by the operators of this package.

An Arrow string column is read in place as one byte array with the bounds of each text. Words,
their hashes and windows of them are then found for many texts at once. Slices hold about
``SLICE`` bytes, or one longer text, which bounds the memory of a task.
"""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
PIECE = 256
_P = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def release_memory() -> None:
    """What Arrow and the C library hold unused goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


_kept: set[Callable[[], None]] = set()


def begin(free: Callable[[], None] | None) -> None:
    """A worker's task begins: what kernels of another kind keep there goes."""
    for other in _kept - {free}:
        other()
    _kept.clear()
    if free:
        _kept.add(free)


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], free: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel; at the end of its task unused memory goes back to the system, as workers live on between tasks.

    free drops what the kernel keeps from task to task; it is called before a task of another kernel.
    """

    @functools.wraps(kernel)
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(free)
        try:
            yield from kernel(batches)
        finally:
            release_memory()

    return each


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pseudo_random(n: int, seed: int = 0) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 1_000_003)) * _U(_P))


BYTE_VALUES = pseudo_random(256, 1)
_lower = np.arange(256)
_lower[65:91] += 32
LOWER_BYTE_VALUES = BYTE_VALUES[_lower]

#: Words [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text in which A-Z are lower-cased.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class _Powers:
    """Powers of the hash's odd multiplier and of its inverse modulo 2^64, up to the longest slice so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            for name, factor in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
                x = np.full(size, factor, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up, cls.down


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end]; it depends on the span's values and their order, not on its place.

    A polynomial modulo 2^64 over PIECE values; longer spans are hashed as the spans of their pieces' hashes, as
    long words of a Thue-Morse kind would have equal polynomials.
    """
    up, down = _Powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    out = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    long = np.flatnonzero(end - start > PIECE)
    if len(long):
        first, last = start[long], end[long]
        n = -(-(last - first) // PIECE)
        edge = np.append(0, np.cumsum(n))
        opens = np.repeat(first, n) + PIECE * (np.arange(edge[-1]) - np.repeat(edge[:-1], n))
        out[long] = span_hashes(span_hashes(values, opens, np.minimum(opens + PIECE, np.repeat(last, n))), edge[:-1], edge[1:])
    return out


class Texts:
    """Some texts: data has their bytes, text i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def words(self, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the number of words before each text (one more entry than texts)."""
        is_word = inside[self.data]
        first, last = is_word.copy(), is_word.copy()
        np.logical_and(is_word[1:], ~is_word[:-1], out=first[1:])
        np.logical_and(is_word[:-1], ~is_word[1:], out=last[:-1])
        edges = self.bounds[(self.bounds > 0) & (self.bounds < len(self.data))]
        first[edges] = is_word[edges]
        last[edges - 1] = is_word[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(start, self.bounds)

    def char_counts(self) -> np.ndarray:
        lead = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=lead[1:])
        return np.diff(lead[self.bounds])


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, Texts) for runs of rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, last, Texts(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True


def chunks(texts: Texts, limit: int = SLICE) -> Iterator[Texts]:
    """The texts; one that is much longer than limit by itself comes in parts that no pre-token crosses.

    Parts begin at a blank or line feed between two graphic ASCII signs, where every tokenizer here starts a match. A text
    without such places stays whole.
    """
    data = texts.data
    if len(texts) != 1 or len(data) < 2 * limit:
        yield texts
        return
    lo = 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        while hi < len(data):
            part = data[hi - 1 : hi + (1 << 16)]
            cut = np.flatnonzero(((part[1:-1] == 0x20) | (part[1:-1] == 0x0A)) & _GRAPHIC[part[:-2]] & _GRAPHIC[part[2:]])
            if len(cut):
                hi += int(cut[0])
                break
            hi = min(hi + (1 << 16) - 1, len(data))
        yield Texts(data[lo:hi], np.array([0, hi - lo]))
        lo = hi


def windows(hashes: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k hashes within one text, and the runs before each text."""
    n = np.diff(before)
    count = np.maximum(n - k + 1, 0)
    starts = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(starts[-1]) + np.repeat(before[:-1] - starts[:-1], count)
    out = np.zeros(starts[-1], np.uint64)
    for j in range(k):
        out = out * _U(_P) + hashes[at + j]
    return mix64(out), starts


def shingles(hashes: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Like windows(), but a text of 1 to k-1 words has one shingle: all its words."""
    n = np.diff(before)
    short = (n > 0) & (n < k)
    if not short.any():
        return windows(hashes, before, k)
    long, at = windows(hashes, before, k)
    count = np.diff(at) + short
    starts = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(starts[-1], np.uint64)
    is_long = np.repeat(~short, count)
    out[is_long] = long
    for i in np.flatnonzero(short):
        out[starts[i]] = span_hashes(hashes, before[i : i + 1], before[i + 1 : i + 2])[0]
    return out, starts


def distinct_per_text(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    return values, np.searchsorted(text, np.arange(len(before)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the bounds of each text in them, and the byte place of each (one more entry)."""
    lead = (texts.data & 0xC0) != 0x80
    place = np.append(np.flatnonzero(lead), len(texts.data))
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.searchsorted(place, texts.bounds), place


#: Every code point that a text can hold.
ALL_POINTS = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))


def class_table(letters: str, numbers: str, spaces: str) -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 white space, 0 other, as a library's \\p{L}, \\p{N} and \\s have them."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for kind, signs in enumerate((letters, numbers, spaces), 1):
        table[np.frombuffer(signs.encode("utf-32-le"), np.uint32)] = kind
    return table


def contraction_lengths(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters of 's 't 're 've 'm 'll 'd that follow each apostrophe; 0: none. Places beyond the end read as 0."""
    padded = np.concatenate([points, np.zeros(3, points.dtype)])
    a, b = padded[at + 1], padded[at + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    return np.where(one, 1, np.where(two, 2, 0))


def runs(kinds: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest run of one kind within a text."""
    if not len(kinds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(len(kinds), bool)
    edge[1:] = kinds[1:] != kinds[:-1]
    edge[bounds[bounds < len(kinds)]] = True
    start = np.flatnonzero(edge)
    return start, np.append(start[1:], len(kinds))

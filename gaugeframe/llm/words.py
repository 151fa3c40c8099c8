"""Words of whole texts: SQL expressions, and NumPy arrays over Arrow batches.

A word is a maximal run of characters other than the ASCII white space
``[\\x20\\x09-\\x0D]``. The NumPy side works on the UTF-8 bytes of many texts at once
and never makes a Python object for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text whose arrays are in memory at once.
CHUNK_BYTES = 1 << 19

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII punctuation but for the apostrophe, which may belong to letters after it.
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, which must not overlap and must be in order."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    full = lengths > 0
    if full.any():
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        part = _BYTE[data[at + np.repeat(starts, lengths)]]
        part *= powers(int(lengths.max()))[at]
        out[full] = np.add.reduceat(part, first[full])
    return mixed(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of some texts: byte ranges, and for each text the range of its words.

    ``marks`` cuts words also between ASCII letters and ASCII punctuation.
    """

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, marks: bool = False
    ):
        lo, hi = int(offsets[0]), int(offsets[-1])
        data = data[lo:hi]
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets.astype(np.int64) - lo
        inside = ~_IS_SPACE[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = self.offsets[:-1]
        edges = edges[edges < len(data)]
        begins[edges] = inside[edges]
        edges = edges[edges > 0]
        stops[edges - 1] = inside[edges - 1]
        if marks:
            letter, mark = _IS_LETTER[data], _IS_MARK[data]
            cut = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
            begins[1:] |= cut
            stops[:-1] |= cut
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        #: Words of text i are ``bounds[i]:bounds[i + 1]``.
        self.bounds = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return slice_hashes(self.data, self.starts, self.ends)

    def array(self) -> pa.Array:
        """The words as an Arrow array of strings."""
        lengths = self.ends - self.starts
        bytes_ = self.data[spread(self.starts, lengths)] if len(lengths) else self.data[:0]
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(bytes_))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; one text at least."""
    _, offsets = text_buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_chunks(
    texts: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES, marks: bool = False
) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffers(texts)
    for i, j in chunks(texts, limit):
        yield i, j, Words(data, offsets[i : j + 1], lower, marks)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of all ranges, one range after the other."""
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(starts.dtype)
    return np.repeat(shift, lengths) + np.arange(int(lengths.sum()))


def shingle_hashes(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the first word of each run."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.repeat(words.bounds[1:], words.counts)
    first = np.flatnonzero(np.arange(n) + size <= last[:n])
    out = np.zeros(len(first), np.uint64)
    for k, factor in enumerate(powers(size + 1)[1:]):
        out += hashes[first + k] * factor
    return mixed(out), first

"""Interpolated modified Kneser-Ney language model of word pairs.

Words and pairs are counted in Spark: a task counts its texts, codes the sorted counts
compactly and hands them out by hash range; a range is merged, sorted and written by one
task to arrays in the shared folder. Words are sorted by hash, and the place of a word is its
number; pairs are sorted by the numbers of both words, so the pairs of a context lie
together. Scoring workers memory-map the arrays, look up the distinct words and pairs of a
chunk of texts by binary search, and hold no part of the model themselves. Only a row of
totals for each range reaches the driver.

With c(vw) the count of a pair, D the discount for its count (one, two, more), N_k(v) the
number of pairs of v seen k times, and a(w) the number of words seen before w:

    p(w | v) = max(c(vw) - D, 0) / c(v) + gamma(v) p(w)
    p(w)     = max(a(w) - D', 0) / sum a + gamma' / (V + 1)

gamma gives back what the discounts took; the last share is that of an unknown word. A
text starts after a mark and its end is a token.

The model grows with the number of different pairs and must fit the shared folder, which
must be mounted as a file system on all machines. There are as many ranges as the bytes of text
ask for, so what one task merges does not grow; counts have 64 bits; more than 2**32 different
words are an error. Larger orders would not fit the disk
budget of the check tool: see the README.

Defined cases: a null text is empty and has the end alone; words have A-Z in lower case;
without training rows every word is unknown; equal texts have equal scores; an empty table
gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_folder
from .words import Words, word_chunks

END = np.uint64(0x0123456789ABCDEF)
START = np.uint64(0xFEDCBA9876543210)
#: Bytes of text for each range of the model, and entries that a task counts before it hands out.
RANGE_BYTES = 1 << 24
HELD = 3_000_000
CHUNK = 1 << 21


def local_path(folder: str) -> str:
    """The path of a folder for memory mapping."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError("the model needs a shared folder that is mounted as a file system")
    return folder


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def coded(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts by bytes of equal weight: most are zero and vanish."""
    heads = np.diff(keys >> np.uint64(32), prepend=np.uint64(0)).astype("<u4")
    tails = keys.astype("<u4")
    planes = [
        np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T)
        for x in (heads, tails, counts.astype("<u4"), (counts >> np.uint64(32)).astype("<u4"))
    ]
    return zlib.compress(b"".join(p.tobytes() for p in planes), 1)


def decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, 4, -1)
    heads, tails, low, high = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in raw)
    keys = (np.cumsum(heads.astype(np.uint64)) << np.uint64(32)) | tails
    return keys, (high.astype(np.uint64) << np.uint64(32)) | low


class Counts:
    """Counts of one task; hands out rows ``(range, data)``."""

    def __init__(self, edges: np.ndarray):
        #: First keys of all ranges but the first.
        self.edges = edges
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)
        if self.n > HELD:
            keys, counts = merged(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.n = [keys], [counts], len(keys)
            if self.n > HELD // 2:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        keys, counts = merged(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.n = [], [], 0
        cuts = np.concatenate(([0], np.searchsorted(keys, self.edges), [len(keys)]))
        rows = [
            (int(k), coded(keys[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]))
            for k in np.flatnonzero(np.diff(cuts))
        ]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                names=["range", "data"],
            )


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merged counts of each range, from rows ``(range, data)`` sorted by range."""
    at, keys, counts, n = None, [], [], 0
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != at:
                if at is not None:
                    yield (at, *merged(np.concatenate(keys), np.concatenate(counts)))
                at, keys, counts, n = k, [], [], 0
            a, b = decoded(data)
            keys.append(a)
            counts.append(b)
            n += len(a)
            if n > HELD:
                a, b = merged(np.concatenate(keys), np.concatenate(counts))
                keys, counts, n = [a], [b], len(a) // 2
    if at is not None:
        yield (at, *merged(np.concatenate(keys), np.concatenate(counts)))


class Store:
    """Arrays of the model by name and range; written whole or not at all."""

    def __init__(self, folder: str):
        self.folder = folder
        self.open: dict[tuple[str, int], np.ndarray] = {}

    def __getstate__(self):
        return {"folder": self.folder, "open": {}}

    def _path(self, name: str, k: int) -> str:
        return f"{self.folder}/{name}-{k:06d}.npy"

    def write(self, name: str, k: int, values: np.ndarray) -> None:
        os.makedirs(self.folder, exist_ok=True)
        part = f"{self._path(name, k)}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, values)
        os.replace(part, self._path(name, k))

    def read(self, name: str, k: int) -> np.ndarray:
        """The memory-mapped array; empty if the range has none."""
        if (name, k) not in self.open:
            path = self._path(name, k)
            found = os.path.exists(path)
            self.open[name, k] = np.load(path, mmap_mode="r") if found else np.zeros(0, np.uint64)
        return self.open[name, k]


@dataclass
class Model:
    """Where the arrays are, and the totals. ``bases[k]`` is the number of the first word of range k."""

    store: Store
    bits: int
    bases: np.ndarray
    tokens: int
    types: int
    pair_types: int = 0
    pair_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_ones: tuple[int, int, int] = (0, 0, 0)

    @property
    def ranges(self) -> int:
        return 1 << self.bits

    def _each(self, of: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Ranges and the part of sorted range numbers that is theirs."""
        cuts = np.searchsorted(of, np.arange(self.ranges + 1))
        for k in np.unique(of):
            yield int(k), slice(cuts[k], cuts[k + 1])

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1 if unknown) and counts of sorted distinct word hashes."""
        number = np.full(len(hashes), -1, np.int64)
        count = np.zeros(len(hashes), np.int64)
        for k, part in self._each((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            known, counts = self.store.read("words", k), self.store.read("counts", k)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, hashes[part]), len(known) - 1)
            hit = known[at] == hashes[part]
            number[part] = np.where(hit, at + self.bases[k], -1)
            count[part] = np.where(hit, counts[at], 0)
        return number, count

    def _range_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases[1:], numbers, side="right")

    def per_word(self, names: tuple[str, ...], numbers: np.ndarray) -> list[np.ndarray]:
        """Values of sorted word numbers from arrays that follow the words; 0 if unknown."""
        out = [np.zeros(len(numbers), np.int64) for _ in names]
        known = np.flatnonzero(numbers >= 0)
        for k, part in self._each(self._range_of(numbers[known])):
            at = numbers[known[part]] - self.bases[k]
            for values, name in zip(out, names, strict=True):
                found = self.store.read(name, k)
                if len(found):
                    values[known[part]] = found[at]
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs of numbers."""
        count = np.zeros(len(keys), np.int64)
        for k, part in self._each(self._range_of((keys >> np.uint64(32)).astype(np.int64))):
            known, counts = self.store.read("pairs", k), self.store.read("pair_counts", k)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
                count[part] = np.where(known[at] == keys[part], counts[at], 0)
        return count


def _discount(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of one, two and more, from the number of entries seen 1 to 4 times."""
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
        if all(0 < d <= k + 1 for k, d in enumerate(found)):
            return found
    return (0.5, 1.0, 1.5)


def sequences(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of texts: their range, the hashes of all tokens with ends, and the first token of each."""
    for i, j, words in word_chunks(texts, lower=True, limit=CHUNK):
        yield i, j, *_with_ends(words)


def _with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    n = len(words.counts)
    tokens = np.full(len(words.starts) + n, END, np.uint64)
    tokens[np.arange(len(words.starts)) + words.owners] = words.hashes()
    return tokens, words.bounds[:-1] + np.arange(n)


def _pair_keys(model: Model, tokens: np.ndarray, first: np.ndarray):
    """Sorted distinct token hashes with their numbers and counts, which each token is, and
    of each token the number of the one before it."""
    types, which = np.unique(tokens, return_inverse=True)
    number, count = model.numbers(types)
    before = np.empty(len(tokens), np.int64)
    before[1:] = number[which[:-1]]
    before[first] = model.numbers(np.array([START]))[0][0]
    return types, which, number, count, before


class _CountWords:
    def __init__(self, bits: int):
        self.edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(self.edges)
        for batch in batches:
            for _, _, tokens, _ in sequences(batch.column(0)):
                keys, n = np.unique(tokens, return_counts=True)
                yield from counts.add(keys, n.astype(np.uint64))
        yield from counts.add(np.array([START]), np.array([0], np.uint64))
        yield from counts.out()


class _WriteWords:
    def __init__(self, store: Store):
        self.store = store

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, keys, counts in ranges(batches):
            self.store.write("words", k, keys)
            self.store.write("counts", k, counts)
            yield _totals(k, [len(keys), int(counts.sum()), int((counts > 0).sum())])


def _totals(k: int, values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k], pa.int32()), pa.array([values], pa.list_(pa.int64()))],
        names=["range", "totals"],
    )


class _CountPairs:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(self.model.bases[1:].astype(np.uint64) << np.uint64(32))
        for batch in batches:
            for _, _, tokens, first in sequences(batch.column(0)):
                _, which, number, _, before = _pair_keys(self.model, tokens, first)
                keys = (before.astype(np.uint64) << np.uint64(32)) | number[which].astype(np.uint64)
                keys, n = np.unique(keys, return_counts=True)
                yield from counts.add(keys, n.astype(np.uint64))
        yield from counts.out()


def _by_context(model: Model, k: int, keys: np.ndarray, counts: np.ndarray) -> None:
    """Writes, for the words of a range as contexts, the sum of counts and how many are 1, 2, more."""
    context = (keys >> np.uint64(32)).astype(np.int64) - model.bases[k]
    n = int(len(model.store.read("words", k)))
    for name, weight in (
        ("sum", counts),
        ("ones", counts == 1),
        ("twos", counts == 2),
        ("more", counts > 2),
    ):
        values = np.bincount(context, weight.astype(np.float64), minlength=n)
        model.store.write(name, k, values.astype(np.uint64))


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits if all of them fit."""
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 2**32 else counts


class _WritePairs:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, keys, counts in ranges(batches):
            self.model.store.write("pairs", k, keys)
            self.model.store.write("pair_counts", k, narrow(counts))
            _by_context(self.model, k, keys, counts)
            yield _totals(k, [len(keys), *(int((counts == i).sum()) for i in range(1, 5))])


class _CountEndings:
    """How many different words come before each word: from the pairs of a range."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(self.model.bases[1:].astype(np.uint64))
        for batch in batches:
            for k in batch.column(0).to_pylist():
                pairs = self.model.store.read("pairs", int(k))
                for at in range(0, len(pairs), HELD // 4):
                    tails = pairs[at : at + HELD // 4] & np.uint64(2**32 - 1)
                    keys, n = np.unique(tails, return_counts=True)
                    yield from counts.add(keys, n.astype(np.uint64))
        yield from counts.out()


class _WriteEndings:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, keys, counts in ranges(batches):
            n = len(self.model.store.read("words", k))
            values = np.zeros(n, np.uint32)
            values[keys.astype(np.int64) - self.model.bases[k]] = counts
            self.model.store.write("endings", k, values)
            seen = [int((counts == i).sum()) for i in range(1, 5)]
            yield _totals(k, [int(counts.sum()), *seen, int((counts > 2).sum())])


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("range").sortWithinPartitions("range")


def _collected(rows: DataFrame, writer) -> dict[int, list[int]]:
    found = _dealt(rows).mapInArrow(writer, "range int, totals array<long>").collect()
    return {r["range"]: r["totals"] for r in found}


def _sums(totals: dict[int, list[int]], n: int) -> list[int]:
    return [sum(t[i] for t in totals.values()) for i in range(n)]


def train(texts: DataFrame, *, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> Model:
    """Counts ``texts(text)`` and writes the arrays below ``folder``, by default the shared folder."""
    spark: SparkSession = texts.sparkSession
    folder = local_path(folder or shared_folder(spark))
    size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 1
    bits = max(3, (size // range_bytes).bit_length())
    store = Store(folder)
    texts = texts.select("text")
    counted = texts.mapInArrow(_CountWords(bits), "range int, data binary")
    totals = _collected(counted, _WriteWords(store))
    sizes = [totals.get(k, [0])[0] for k in range(1 << bits)]
    _, tokens, types = _sums(totals, 3)
    if sum(sizes) >= 2**32:  # a pair is two numbers in 64 bits
        raise ValueError("more than 2**32 different words")
    bases = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    model = Model(store, bits, bases, tokens, types)
    if not tokens:
        return model
    counted = texts.mapInArrow(_CountPairs(model), "range int, data binary")
    n = _sums(_collected(counted, _WritePairs(model)), 5)
    model.pair_types, model.pair_discounts = n[0], discounts(n[1:])
    every = spark.range(0, 1 << bits, 1, min(1 << bits, 256))
    counted = every.mapInArrow(_CountEndings(model), "range int, data binary")
    n = _sums(_collected(counted, _WriteEndings(model)), 6)
    model.word_discounts, model.word_ones = discounts(n[1:5]), (n[1], n[2], n[5])
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model = model

    def words(self, numbers: np.ndarray) -> np.ndarray:
        """p(w) of sorted word numbers, -1 for unknown ones."""
        m = self.model
        if not m.pair_types:
            return np.full(len(numbers), 1 / (m.types + 1))
        (endings,) = m.per_word(("endings",), numbers)
        back = sum(d * n for d, n in zip(m.word_discounts, m.word_ones, strict=True)) / m.pair_types
        own = np.maximum(endings - _discount(endings, m.word_discounts), 0) / m.pair_types
        return own + back / (m.types + 1)

    def tokens(self, tokens: np.ndarray, first: np.ndarray):
        """Of each token: log10 p(w | v), its count in training, and log10 of its base probability."""
        m = self.model
        types, which, number, count, before = _pair_keys(m, tokens, first)
        word_p = np.zeros(len(types))
        order = np.argsort(number)
        word_p[order] = self.words(number[order])
        base = np.log10((count + 1) / (m.tokens + m.types + 1))
        p = word_p[which]
        contexts, of = np.unique(before, return_inverse=True)
        total, *seen = m.per_word(("sum", "ones", "twos", "more"), contexts)
        with np.errstate(invalid="ignore", divide="ignore"):
            gamma = sum(d * n for d, n in zip(m.pair_discounts, seen, strict=True)) / total
        gamma = np.where(total > 0, gamma, 1.0)
        p = p * gamma[of]
        both = np.flatnonzero((before >= 0) & (number[which] >= 0) & (total[of] > 0))
        keys = (before[both].astype(np.uint64) << np.uint64(32)) | number[which[both]].astype(np.uint64)
        keys, at = np.unique(keys, return_inverse=True)
        pair = m.pairs(keys)
        own = np.maximum(pair - _discount(pair, m.pair_discounts), 0)
        p[both] += own[at] / total[of[both]]
        return np.log10(p), count[which], base[which]


class _Score:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(self.model)
        for batch in batches:
            for i, j, tokens, first in sequences(batch.column(1)):
                p, count, base = scorer.tokens(tokens, first)
                n = np.diff(np.append(first, len(tokens)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                        pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(p, first)),
                    ],
                    names=["id", "n_tokens", "n_known", "base_score", "score"],
                )


def score(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` of each row; scores are log10 probabilities.

    Perplexity is ``10 ** (-score / n_tokens)``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        _Score(model), f"id {kind}, n_tokens long, n_known long, base_score double, score double"
    )

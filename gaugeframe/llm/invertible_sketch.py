"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs; the digest of each is added to one cell in each of three
parts of a small table. A cell holds how many digests it got, their exclusive or, and that
of a check value. The tables of two versions subtract cell by cell, and what both share
vanishes. Cells left with one digest give it away; taking it out of its other cells frees
more, until the digests that only one version has are all recovered. If that gets stuck,
both texts are sketched anew in four times as many cells, which always ends: a table far
larger than the difference peels.

A paragraph ends at a line end, after a word that ends a sentence, after a word whose hash
says so (one in eight), or after twelve words, so that texts of one line have parts as well
and an edit moves few other cuts. The nth copy of a paragraph in a text has a digest of its own.

Edited versions and neighbours: rows are dealt to ranges of the id, sorted there, and read
in order with one row held back; the first row of a range is dealt to the range before as
well.

Defined cases: a null text counts as empty and has an empty fingerprint; two empty texts
are alike, an empty and another are not; equal texts have equal fingerprints; rows with
equal ids follow each other by text; a null id comes first; the only row is its own next;
an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, chunks, mixed, slice_hashes, text_buffers

CELLS = 24
PARTS = 3
GROWTH = 4
#: Most words in a paragraph.
LONGEST = 12
#: Text that a range holds, on average, unless the table is small.
RANGE_BYTES = 1 << 22
#: Beyond so many rounds the sets are compared directly.
ROUNDS = 12
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_COPY = np.uint64(0x9E3779B97F4A7C15)
_CHECK = np.uint64(0xC2B2AE3D27D4EB4F)


def paragraph_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all paragraphs of the texts, and the text of each, in order of text and digest."""
    words = Words(data, offsets)
    data, offsets = words.data, words.offsets
    starts, ends, owners = words.starts, words.ends, words.owners
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    # a paragraph begins at a text's begin and at each word that follows a cut
    begins = offsets[:-1][np.diff(offsets) > 0]
    if len(starts) > 1:
        same = owners[1:] == owners[:-1]
        cut = _ENDS[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
        cut |= (slice_hashes(data, starts, ends)[:-1] & np.uint64(7)) == 0
        # words since the last cut or the begin of the text
        since = np.arange(len(starts))
        since -= np.maximum.accumulate(np.where(np.append(True, ~same | cut), since, 0))
        cut |= since[1:] % LONGEST == 0
        begins = np.union1d(begins, starts[1:][same & cut])
    owner = np.searchsorted(offsets, begins, side="right") - 1
    stops = np.append(begins[1:], offsets[-1]) if len(begins) else begins
    digests = slice_hashes(data, begins, np.minimum(stops, offsets[owner + 1]))
    order = np.lexsort((digests, owner))
    digests, owner = digests[order], owner[order]
    new = np.concatenate(([True], (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])))
    if len(digests):
        run = np.flatnonzero(new)
        copy = np.arange(len(digests)) - np.repeat(run, np.diff(np.append(run, len(digests))))
        digests = mixed(digests + copy.astype(np.uint64) * _COPY)
    return digests, owner


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key in each part of a table."""
    part = np.uint64(cells // PARTS)
    salt = mixed(np.arange(PARTS, dtype=np.uint64) + np.uint64(cells * PARTS))
    return np.stack(
        [
            (mixed(keys ^ salt[p]) % part + part * np.uint64(p)).astype(np.int64)
            for p in range(PARTS)
        ]
    )


def check_values(keys: np.ndarray) -> np.ndarray:
    return mixed(keys * _CHECK) & np.uint64(0xFFFFFFFF)


class Tables:
    """Sketches of many texts: arrays of ``texts * cells`` cells."""

    def __init__(self, texts: int, cells: int):
        self.texts, self.cells = texts, cells
        self.count = np.zeros(texts * cells, np.int64)
        self.keys = np.zeros(texts * cells, np.uint64)
        self.checks = np.zeros(texts * cells, np.uint64)

    def add(self, keys: np.ndarray, owners: np.ndarray, signs=1) -> None:
        check = check_values(keys)
        for place in places(keys, self.cells):
            at = owners * self.cells + place
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)

    def minus(self, other: Tables) -> Tables:
        out = Tables(self.texts, self.cells)
        out.count = self.count - other.count
        out.keys = self.keys ^ other.keys
        out.checks = self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered keys, their texts and signs; and which texts came apart wholly."""
        found = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            look = look[np.abs(self.count[look]) == 1]
            look = look[check_values(self.keys[look]) == self.checks[look]]
            keys, owners, signs = self.keys[look], look // self.cells, self.count[look]
            # a key may stand alone in several of its cells
            order = np.lexsort((keys, owners))
            keys, owners, signs = keys[order], owners[order], signs[order]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
            keys, owners, signs = keys[first], owners[first], signs[first]
            if not len(keys):
                break
            found.append((keys, owners, signs))
            self.add(keys, owners, -signs)
            look = np.unique((owners * self.cells + places(keys, self.cells)).ravel())
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        done = ~left.reshape(self.texts, self.cells).any(axis=1)
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, owners, signs = (
            np.concatenate([x[k] for x in found]) if found else empty[k] for k in range(3)
        )
        keep = done[owners]
        return keys[keep], owners[keep], signs[keep], done

    def texts_base64(self) -> list[str]:
        """Each table as text: count, digest and check of each cell."""
        kind = np.dtype([("n", "<i4"), ("key", "<u8"), ("check", "<u4")])
        raw = np.empty((self.texts, self.cells), kind)
        for name, values in (("n", self.count), ("key", self.keys), ("check", self.checks)):
            raw[name] = values.reshape(self.texts, self.cells)
        return [base64.b64encode(row.tobytes()).decode() for row in raw]


Digests = tuple[np.ndarray, np.ndarray]


def _select(digests: Digests, which: np.ndarray, new: np.ndarray) -> Digests:
    """The digests of the texts ``which``, with ``new`` numbers."""
    keys, owners = digests
    keep = which[owners]
    return keys[keep], new[owners[keep]]


def differences(
    a: Digests, b: Digests, texts: int, first: tuple[Tables, Tables] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests that one version of a text has alone: keys, texts, signs (1 for ``a``, -1 for ``b``);
    and how many rounds each text took. ``first`` are the tables of the first round if known.
    """
    out, rounds = [], np.zeros(texts, np.int64)
    open_ = np.arange(texts)
    cells = CELLS
    for turn in range(ROUNDS):
        if not len(open_):
            break
        if turn or first is None:
            which, new = np.zeros(texts, bool), np.zeros(texts, np.int64)
            which[open_], new[open_] = True, np.arange(len(open_))
            ta, tb = Tables(len(open_), cells), Tables(len(open_), cells)
            ta.add(*_select(a, which, new))
            tb.add(*_select(b, which, new))
        else:
            ta, tb = first
        keys, owners, signs, done = ta.minus(tb).peel()
        out.append((keys, open_[owners], signs))
        rounds[open_] = turn + 1
        open_ = open_[~done]
        cells *= GROWTH
    for k in open_:
        x, y = (s[0][s[1] == k] for s in (a, b))
        for keys, sign in ((np.setdiff1d(x, y), 1), (np.setdiff1d(y, x), -1)):
            out.append((keys, np.full(len(keys), k), np.full(len(keys), sign)))
    keys, owners, signs = (np.concatenate([x[i] for x in out]) for i in range(3)) if out else (
        np.zeros(0, np.uint64),
        np.zeros(0, np.int64),
        np.zeros(0, np.int64),
    )
    return keys, owners, signs, rounds


def likeness(a: Digests, b: Digests, texts: int, owners: np.ndarray) -> np.ndarray:
    """Twice the shared paragraphs over all, from the owners of the differing digests."""
    total = np.bincount(a[1], minlength=texts) + np.bincount(b[1], minlength=texts)
    differ = np.bincount(owners, minlength=texts)
    return np.where(total > 0, (total - differ) / np.maximum(total, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the first code points of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(ids: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    n = len(texts)
    found, tables = [], []
    for version in (texts, changed, following):
        data, offsets = text_buffers(pa.array(version, pa.string()))
        digests = paragraph_digests(data, offsets)
        table = Tables(n, CELLS)
        table.add(*digests)
        found.append(digests)
        tables.append(table)
    near, counts = [], []
    for k in (1, 2):
        _, owners, _, _ = differences(found[0], found[k], n, (tables[0], tables[k]))
        near.append(likeness(found[0], found[k], n, owners))
        counts.append(np.bincount(owners, minlength=n))
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(changed, pa.string()),
            pa.array(tables[0].texts_base64(), pa.string()),
            pa.array(tables[1].texts_base64(), pa.string()),
            pa.array(near[0]),
            pa.array(near[1]),
            pa.array(counts[0], pa.int64()),
        ],
        names=[
            "id",
            "n_chars",
            "edited",
            "fingerprint",
            "edited_fingerprint",
            "near_edited",
            "near_next",
            "n_changed",
        ],
    )


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row with the one after it in its range."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        for i, j in chunks(batch.column(2).slice(0, max(batch.num_rows - 1, 0))):
            part = batch.slice(i, j - i + 1)
            bucket = part.column(0).to_numpy()
            own = ~part.column(1).to_numpy(zero_copy_only=False)[:-1]
            own &= bucket[1:] == bucket[:-1]
            texts = part.column(2).to_pylist()
            rows = np.flatnonzero(own)
            if len(rows):
                yield _compare(
                    part.column(3).take(pa.array(rows)),
                    [texts[r] for r in rows],
                    [texts[r + 1] for r in rows],
                )
        held = batch.slice(batch.num_rows - 1)


def _range_of(cuts: list[int]) -> Column:
    """The number of cuts at or below ``id``: first among some of the cuts, then between two of those."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    id_ = F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)))  # a null comes before all ids

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= id_))

    block = upto(F.lit(cuts[::step]))
    inside = upto(F.slice(F.lit(cuts), (block - 1) * step + 1, step))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def _cuts(rows: DataFrame, ranges: int) -> list[int]:
    """The smallest ids of at most ``ranges`` ranges of about as many rows, but for the first.

    A sketch proposes values, which need not be ids; one aggregate finds the smallest id of
    each range between them.
    """
    if ranges < 2:
        return []
    at = [i / ranges for i in range(1, ranges)]
    rough = rows.agg(
        F.percentile_approx(F.col("id").cast("long"), at, max(10_000, 10 * ranges)).alias("cuts")
    ).first()["cuts"]
    near = _range_of(sorted(set(rough or ())))
    first = rows.where("id IS NOT NULL").groupBy(near.alias("r")).agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in first.collect())[1:]


def ranged(rows: DataFrame, ranges: int) -> DataFrame:
    """``range, borrowed, text, id``: rows by range of ``id``, and the first row of each range in
    the one before too (that of the first range in the last).
    """
    seen = rows.agg(
        F.min("id").alias("first"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")
    ).first()
    first = None if seen["nulls"] else seen["first"]
    cuts = _cuts(rows, ranges)
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("borrowed"))
    lent = F.when(F.col("id").eqNullSafe(F.lit(first)), F.lit(len(cuts))).when(
        F.col("id").isin(cuts) if cuts else F.lit(False), F.col("range") - 1
    )
    both = F.array(own, F.struct(lent.cast("int").alias("range"), F.lit(True).alias("borrowed")))
    return (
        rows.withColumn("range", _range_of(cuts))
        .select("id", "text", F.explode(F.when(lent.isNull(), F.array(own)).otherwise(both)).alias("r"))
        .select("r.range", "r.borrowed", "text", "id")
    )


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None
) -> DataFrame:
    """``id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, n_changed``.

    ``edited`` is the text with its last quarter from the next row's; ``n_changed`` counts the
    paragraph digests recovered from the difference of both fingerprints. Ids are integers of
    any size. There are as many ranges as hold about ``RANGE_BYTES`` of text each, several for
    a task, so tasks read about as much as each other.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must hold integers")
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    if ranges is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        least = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(least, -(-total // RANGE_BYTES))
    dealt = ranged(rows, ranges).repartition("range")
    return dealt.sortWithinPartitions("range", "borrowed", F.asc_nulls_first("id"), "text").mapInArrow(
        _follow,
        f"id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double, n_changed long",
    )

"""Line dedup with two Bloom filters.

One pass hashes the long lines of every document into two filters: seen once, and seen
again. Each task fills filters of its own; pieces of them are shuffled and merged, and
what two tasks have both seen once has been seen again. A second pass shuffles only lines
that the merged filter suspects, with their key, for the exact count and the choice of the
document that keeps them. The filter has a fixed largest size, so it may be sent to all
tasks; where the lines outgrow it more of them are suspected, and results stay exact.

A line's key is the line without ASCII white space at its ends and in lower case (A-Z).
Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose their
lines except in the largest id.

Defined cases: a null or empty text is one empty line; a line repeated within a document
counts once there and keeps all its places in the keeper; rows count as documents, so rows
with the same id all keep a line if that id is the largest; a null id is smaller than any
other and loses to it; an empty table gives an empty table; other columns, whatever their
names, pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import SPACES, UPPER, chunks, slice_hashes, text_buffers

MIN_BITS, MAX_BITS = 20, 28
PIECE_BITS = 19
PROBES = 2


def line_keys(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, pa.Array]:
    """Document and key of each line whose key is long enough."""
    lines = pc.split_pattern(texts, "\n")
    owners = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = pc.ascii_lower(pc.utf8_trim(lines.flatten(), characters=SPACES))
    keep = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
    return owners[keep], keys.filter(pa.array(keep))


def _hashes(keys: pa.Array) -> np.ndarray:
    data, ends = text_buffers(keys)
    ends = ends.astype(np.int64)
    return slice_hashes(data, ends[:-1], ends[1:])


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash in a filter of ``2**bits`` bits: one row for each probe."""
    mask = np.uint64((1 << bits) - 1)
    return np.stack([(hashes >> np.uint64(32 * i)) & mask for i in range(PROBES)])


def _all_set(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    at = np.unique(at)
    np.bitwise_or.at(packed, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    texts = batch.column(batch.schema.get_field_index("text")).fill_null("")
    for i, j in chunks(texts, 1 << 21):
        yield i, j, texts.slice(i, j - i)


class _Fill:
    """Filters of one task, emitted in pieces."""

    def __init__(self, bits: int, min_chars: int):
        self.bits, self.min_chars = bits, min_chars

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << self.bits) // 8
        once, again = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            for _, _, texts in _texts(batch):
                owners, keys = line_keys(texts, self.min_chars)
                if not len(keys):
                    continue
                h = _hashes(keys)
                # each key once a document, then once a chunk with whether it came twice
                pairs = np.unique(np.rec.fromarrays([h, owners], names="h,o"))
                seen, n = np.unique(pairs["h"], return_counts=True)
                at = _bits(seen, self.bits)
                twice = _all_set(once, at) | (n > 1)
                _set(again, at[:, twice])
                _set(once, at)
        step = (1 << PIECE_BITS) // 8
        for k in range(0, size, step):
            if once[k : k + step].any():
                packed = [x[k : k + step].tobytes() for x in (once, again)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "piece": pa.array([k // step], pa.int32()),
                        "once": pa.array([zlib.compress(packed[0], 1)], pa.binary()),
                        "again": pa.array([zlib.compress(packed[1], 1)], pa.binary()),
                    }
                )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter of what was seen again, from rows sorted by piece."""
    piece, once, again = None, None, None

    def out():
        return pa.RecordBatch.from_pydict(
            {
                "piece": pa.array([piece], pa.int32()),
                "again": pa.array([zlib.compress(again.tobytes(), 1)], pa.binary()),
            }
        )

    for batch in batches:
        for row in batch.to_pylist():
            a, b = (
                np.frombuffer(zlib.decompress(row[k]), np.uint8) for k in ("once", "again")
            )
            if row["piece"] != piece:
                if piece is not None:
                    yield out()
                piece, once, again = row["piece"], a.copy(), b.copy()
            else:
                again |= b | (once & a)
                once |= a
    if piece is not None:
        yield out()


class _Suspects:
    """Keys that the filter has seen again: one row for each key of a document."""

    def __init__(self, bits: int, min_chars: int, pieces):
        self.bits, self.min_chars, self.pieces = bits, min_chars, pieces

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = (1 << PIECE_BITS) // 8
        again = np.zeros((1 << self.bits) // 8, np.uint8)
        for k, packed in self.pieces.value:
            part = np.frombuffer(zlib.decompress(packed), np.uint8)
            again[k * step : k * step + len(part)] = part
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for i, j, texts in _texts(batch):
                owners, keys = line_keys(texts, self.min_chars)
                if not len(keys):
                    continue
                hashes = _hashes(keys)
                hit = np.flatnonzero(_all_set(again, _bits(hashes, self.bits)))
                pairs = np.rec.fromarrays([owners[hit], hashes[hit]], names="o,h")
                hit = hit[np.unique(pairs, return_index=True)[1]]
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(i, j - i).take(pa.array(owners[hit])), keys.take(pa.array(hit))],
                        names=["id", "key"],
                    )


def filter_bits(docs: DataFrame, max_bits: int = MAX_BITS) -> int:
    """Bits of a filter over ``docs(text)``: one for 16 to 32 bytes of text, as a power of two."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 1
    return max(MIN_BITS, min(max_bits, total.bit_length() - 5))


def repeated_keys(
    docs: DataFrame,
    *,
    min_chars: int = 20,
    min_docs: int = 3,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``id, keys``: the keys whose lines each document of ``docs(id, text)`` loses."""
    if min_docs < 2:
        raise ValueError("the filter knows what at least 2 documents share")
    bits = filter_bits(docs, max_bits)
    pieces = (
        docs.select("text")
        .mapInArrow(_Fill(bits, min_chars), "piece int, once binary, again binary")
        .repartition("piece")
        .sortWithinPartitions("piece")
        .mapInArrow(_merge, "piece int, again binary")
    )
    # together at most 2**max_bits bits
    merged = [(r["piece"], bytes(r["again"])) for r in pieces.collect()]
    held = docs.sparkSession.sparkContext.broadcast(merged)
    id_type = docs.schema["id"].dataType.simpleString()
    suspects = written(
        docs.select("id", "text").mapInArrow(
            _Suspects(bits, min_chars, held), f"id {id_type}, key string"
        )
    )
    confirmed = (
        suspects.groupBy("key")
        .agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
    )
    lost = suspects.join(confirmed, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id").agg(F.collect_set("key").alias("keys"))


def line_key(line: Column) -> Column:
    """The key of a line as a SQL expression."""
    return F.btrim(F.translate(line, UPPER, UPPER.lower()), F.lit(SPACES))


def without_repeated_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``doc`` (the row), ``lines`` and ``left``: the lines of each text, and those that stay."""
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    lost = repeated_keys(plain, **options)
    rows = docs.select(docs[id_col].alias("id"), F.struct("*").alias("doc"))
    joined = rows.join(lost, rows["id"].eqNullSafe(lost["id"]), "left")
    lines = F.split(F.coalesce(F.col("doc")[text_col], F.lit("")), "\n")
    left = F.when(F.col("keys").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains("keys", line_key(x)))
    )
    return joined.select("doc", lines.alias("lines"), left.alias("left"))


def drop_repeated_lines(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the text that is left; a text that loses nothing stays as it is, null too."""
    rows = without_repeated_lines(docs, text_col=text_col, **options)
    text = F.when(F.size("left") == F.size("lines"), F.col("doc")[text_col]).otherwise(
        F.array_join("left", "\n")
    )
    return rows.select(F.col("doc").withField(f"`{text_col}`", text).alias("doc")).select("doc.*")

"""Exact removal of long repeated passages with FM-indexes.

Every window of ``window`` words has an anchor: the run of ``gram`` words with the smallest
hash in it, the leftmost of equals. Equal windows have equal anchors, so windows are dealt
by anchor, and consecutive windows with the same anchor travel together as one segment.
Only segments whose anchor occurs twice or more can hold a repeated window. Segments of
equal words are one, with their number as weight.

An FM-index is built for each shard of segments. The segments are streamed against it:
backward search tells which of their windows weigh two or more, in ranges. An anchor that
very many different segments share has several indexes; each of its segments searches all
of them, for one occurrence in those that do not hold it. The ranges then tell each document which words to lose.

Documents with equal words are one class. Only one of a class is cut into segments; if the
class has several documents, every window of theirs is repeated.

Defined cases: a null text, or one of fewer words than a window, loses nothing; windows
are judged on the input, also where they overlap; rows equal in all columns are copies of
each other; rows with the same id and other texts are told apart by their words; an empty
table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FIRST_WORD, FMIndex, repeated_windows
from .storage import written
from .words import Words, shingle_hashes, word_chunks

WINDOW = 35
GRAM = 12
#: Bytes of segments in an index, and segments of one anchor from which it is split.
SHARD_BYTES = 1 << 22
ANCHOR_SEGMENTS = 10_000


def digest_of(hashes: np.ndarray) -> bytes:
    """Digest of a sequence of word hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def segments(words: Words, hashes: np.ndarray, window: int, gram: int):
    """Anchors, first and last window of all segments, as places among all words; and their texts."""
    n = len(hashes)
    grams, first = shingle_hashes(words, hashes, gram)
    value = np.full(n, np.uint64(2**64 - 1))
    value[first] = grams
    end = np.repeat(words.bounds[1:], words.counts)
    valid = np.flatnonzero(np.arange(n) + window <= end)
    # leftmost smallest gram among ``window - gram + 1`` starts, by doubling
    at, width, span = np.arange(n), 1, window - gram + 1
    while width < span:
        step = min(width, span - width)
        right = at[step:]
        left = at[: len(right)]
        at = np.concatenate((np.where(value[right] < value[left], right, left), at[len(right) :]))
        width += step
    owner = at[valid]
    if not len(valid):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1] + 1)))
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(valid)) - 1
    text = np.searchsorted(words.bounds, valid[start], side="right") - 1
    return value[owner[start]], valid[start], valid[stop], text


class _Anchors:
    """``id, n, digest, anchors`` of each text."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column(1)):
                hashes = words.hashes()
                anchors, _, _, text = segments(words, hashes, self.window, self.gram)
                ends = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(words.counts, pa.int64()),
                        pa.array(
                            [
                                digest_of(hashes[a:b])
                                for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)
                            ],
                            pa.binary(),
                        ),
                        pa.ListArray.from_arrays(
                            pa.array(ends), pa.array(anchors.view(np.int64), pa.int64())
                        ),
                    ],
                    names=["id", "n", "digest", "anchors"],
                )


class _Cut:
    """Segments whose anchors the row names: ``anchor, segment, text, id, digest, start, windows``.

    The text of equal segments is given once a batch.
    """

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column(2)
            ids = batch.column(0)
            seen: set[bytes] = set()
            for i, j, words in word_chunks(batch.column(1)):
                hashes = words.hashes()
                anchors, start, stop, text = segments(words, hashes, self.window, self.gram)
                cuts = np.searchsorted(text, np.arange(j - i + 1))
                rows = []
                for k in range(j - i):
                    wanted = named[i + k]
                    part = slice(cuts[k], cuts[k + 1])
                    if not wanted.is_valid or cuts[k] == cuts[k + 1]:
                        continue
                    wanted = wanted.values.to_numpy(zero_copy_only=False).view(np.uint64)
                    a, b = words.bounds[k], words.bounds[k + 1]
                    digest = digest_of(hashes[a:b])
                    for m in np.flatnonzero(np.isin(anchors[part], wanted)) + cuts[k]:
                        x, y = start[m], stop[m] + self.window
                        segment = digest_of(hashes[x:y])
                        given = None
                        if segment not in seen:
                            seen.add(segment)
                            # words as they are, with whatever space is between them
                            given = bytes(words.data[words.starts[x] : words.ends[y - 1]]).decode()
                        rows.append(
                            (
                                int(anchors[m].view(np.int64)),
                                segment,
                                given,
                                ids[i + k].as_py(),
                                digest,
                                int(x - a),
                                int(stop[m] - start[m] + 1),
                            )
                        )
                if rows:
                    names = ["anchor", "segment", "text", "id", "digest", "start", "windows"]
                    types = [
                        pa.int64(), pa.binary(), pa.string(), ids.type, pa.binary(),
                        pa.int32(), pa.int32(),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(c, t)
                            for c, t in zip(zip(*rows, strict=True), types, strict=True)
                        ],
                        names=names,
                    )


class _Search:
    """Ranges of repeated windows of the segments of a shard.

    Rows ``(shard, indexed, segment, text, weight)`` come sorted by shard, the indexed first.
    """

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, indexed, index = None, [], None
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            at = np.flatnonzero(
                [i == 0 or rows[0][i] != rows[0][i - 1] or rows[1][i] != rows[1][i - 1]
                 for i in range(batch.num_rows)]
            )
            for a, b in zip(at, [*at[1:], batch.num_rows], strict=True):
                if rows[0][a] != shard:
                    if indexed:
                        yield from self._built(indexed)[1]
                    shard, indexed, index = rows[0][a], [], None
                part = list(zip(rows[2][a:b], rows[3][a:b], rows[4][a:b], strict=True))
                if rows[1][a]:
                    indexed += part
                elif indexed or index is not None:  # an empty index finds nothing
                    if index is None:
                        index, found = self._built(indexed)
                        indexed = []
                        yield from found
                    yield from self._searched(index, part, 1)
        if indexed:
            yield from self._built(indexed)[1]

    def _numbers(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        data = pa.array(texts, pa.string())
        parts, counts = [], []
        for _, _, words in word_chunks(data, limit=1 << 22):
            parts.append(words.array())
            counts.append(words.counts)
        return pa.concat_arrays(parts), np.concatenate(counts)

    def _built(self, rows):
        words, lengths = self._numbers([r[1] for r in rows])
        coded = words.dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + FIRST_WORD
        weights = np.array([r[2] for r in rows], np.int64)
        index = FMIndex(numbers, lengths, weights, len(coded.dictionary) + FIRST_WORD)
        held = (index, coded.dictionary)
        return held, self._found(index, [r[0] for r in rows], numbers, lengths, 2)

    def _searched(self, held, rows, least: int):
        index, dictionary = held
        words, lengths = self._numbers([r[1] for r in rows])
        numbers = pc.index_in(words, dictionary).fill_null(-1 - FIRST_WORD)
        numbers = numbers.to_numpy(zero_copy_only=False).astype(np.int64) + FIRST_WORD
        return self._found(index, [r[0] for r in rows], numbers, lengths, least)

    def _found(self, index, names, numbers, lengths, least: int) -> Iterator[pa.RecordBatch]:
        query, low, high = repeated_windows(
            index, numbers, np.cumsum(lengths) - lengths, lengths, least, self.window
        )
        if len(query):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[q] for q in query], pa.binary()),
                    pa.array(low, pa.int32()),
                    pa.array(high, pa.int32()),
                ],
                names=["segment", "low", "high"],
            )


class _Remove:
    """``id, n_words, n_removed, kept`` of each text."""

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, ranges, copies = batch.columns
            for i, j, words in word_chunks(texts):
                hashes = words.hashes()
                removed, kept = [], []
                for k in range(j - i):
                    a, b = int(words.bounds[k]), int(words.bounds[k + 1])
                    lost = np.zeros(b - a + 1, np.int64)
                    if ranges[i + k].is_valid or copies[i + k].is_valid:
                        digest = digest_of(hashes[a:b])
                        if b - a >= self.window and digest in (copies[i + k].as_py() or ()):
                            lost[0] = 1
                        for r in ranges[i + k].as_py() or ():
                            if r["digest"] == digest:
                                lost[r["low"]] += 1
                                lost[r["high"] + self.window] -= 1
                    stays = np.cumsum(lost[:-1]) == 0
                    removed.append(int((~stays).sum()))
                    left = np.flatnonzero(stays) + a
                    data = words.data
                    kept.append(
                        b" ".join(
                            data[x:y].tobytes()
                            for x, y in zip(words.starts[left], words.ends[left], strict=True)
                        ).decode()
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array(words.counts, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(kept, pa.string()),
                    ],
                    names=["id", "n_words", "n_removed", "kept"],
                )


def sharded(found: DataFrame, shard_bytes: int, anchor_segments: int) -> DataFrame:
    """``shard, indexed, segment, text, weight``: each distinct segment in its index, and those of
    an anchor with several indexes as searches in the others.
    """
    distinct = written(
        found.groupBy("anchor", "segment").agg(
            F.max("text").alias("text"), F.count("*").alias("weight")
        )
    )
    total = distinct.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    shards = total // shard_bytes + 1
    crowded = (
        distinct.groupBy("anchor")
        .agg(F.count("*").alias("k"))
        .where(F.col("k") > anchor_segments)
        .select("anchor", F.ceil(F.col("k") / anchor_segments).cast("int").alias("blocks"))
    )
    rows = distinct.join(crowded, "anchor", "left")
    block = F.pmod(F.xxhash64("segment"), F.col("blocks")).cast("int")
    own = F.when(
        F.col("blocks").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("string")
    )
    every = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda b: F.struct(
            F.concat_ws("/", F.col("anchor"), b).alias("shard"), (b == block).alias("indexed")
        ),
    )
    places = F.when(
        F.col("blocks").isNull(),
        F.array(F.struct(own.alias("shard"), F.lit(True).alias("indexed"))),
    ).otherwise(every)
    return rows.select(F.explode(places).alias("p"), "segment", "text", "weight").select(
        "p.shard", "p.indexed", "segment", "text", "weight"
    )


def remove_repeated(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    anchor_segments: int = ANCHOR_SEGMENTS,
) -> DataFrame:
    """``id, n_words, n_removed, kept``: the words that are left, joined by one space."""
    if not 0 < gram <= window:
        raise ValueError("gram must be from 1 to window")
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    sketches = written(
        plain.mapInArrow(
            _Anchors(window, gram), f"id {kind}, n long, digest binary, anchors array<long>"
        )
    )
    classes = written(
        sketches.where(F.col("n") >= window)
        .groupBy("digest")
        .agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    # all but one document of a class are left out of the search
    rest = sketches.where(F.size("anchors") > 0).join(classes, "digest", "left")
    chosen = rest.where(F.col("copies").isNull() | F.col("id").eqNullSafe(F.col("least")))
    anchors = written(chosen.select("id", F.explode("anchors").alias("anchor")))
    twice = anchors.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    named = (
        anchors.join(twice.select("anchor"), "anchor")
        .groupBy("id")
        .agg(F.collect_set("anchor").alias("anchors"))
    )
    texts = plain.join(named, plain["id"].eqNullSafe(named["id"])).select(
        plain["id"], "text", "anchors"
    )
    found = written(
        texts.mapInArrow(
            _Cut(window, gram),
            "anchor long, segment binary, text string, "
            f"id {kind}, digest binary, start int, windows int",
        )
    )
    ranges = written(
        sharded(found, shard_bytes, anchor_segments)
        .repartition("shard")
        .sortWithinPartitions("shard", F.desc("indexed"))
        .mapInArrow(_Search(window), "segment binary, low int, high int")
    )
    lost = (
        found.select("segment", "id", "digest", "start")
        .join(ranges, "segment")
        .groupBy("id")
        .agg(
            F.collect_set(
                F.struct(
                    "digest",
                    (F.col("start") + F.col("low")).alias("low"),
                    (F.col("start") + F.col("high")).alias("high"),
                )
            ).alias("ranges")
        )
    )
    copies = (
        sketches.select("id", "digest")
        .join(classes.select("digest"), "digest")
        .groupBy("id")
        .agg(F.collect_set("digest").alias("copies"))
    )
    facts = lost.join(copies, lost["id"].eqNullSafe(copies["id"]), "full").select(
        F.coalesce(lost["id"], copies["id"]).alias("id"), "ranges", "copies"
    )
    joined = plain.join(facts, plain["id"].eqNullSafe(facts["id"]), "left")
    return joined.select(plain["id"], "text", "ranges", "copies").mapInArrow(
        _Remove(window), f"id {kind}, n_words long, n_removed long, kept string"
    )

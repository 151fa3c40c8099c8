"""Packing documents into training sequences of balanced cost.

A task tokenizes its documents and packs them in groups of bounded size: ids of a few
million tokens are in memory at once, whatever the size of the table. Attention over a piece
of n tokens costs ``n + attention * n**2``. A group fills as many sequences as its tokens make
full ones: pieces in descending order go to the sequence of lowest cost that has room. A
piece that fits nowhere whole is cut to fill the sequence with most room. What is left joins
the next group. What a task has left at its end, less than one sequence, is handed out: the
rests of ``TASKS`` tasks are packed together as a group of their own, then the rests of so
many groups, until one group is left. Only the rest of that one, less than a sequence of the
whole table, goes to sequences of powers of two, which need no padding either. The pieces are
written once, so a task that is lost later does not tokenize again; one that runs again packs
the same.

Tokens are looked up by distinct words. A cut at white space, or between an ASCII letter
and ASCII punctuation, is a cut for the tokenizer too, so ids are those of the whole text.

Defined cases: a null text counts as empty and has the end id alone; a null id is a
document as any other; rows equal in all columns are packed each; long texts are cut;
an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import spread, word_chunks

#: Cost of a pair of tokens against that of one token, for models about 1,024 wide.
ATTENTION = 1 / 6144
CACHED_WORDS = 250_000
#: Tasks, or groups of them, whose rests are packed together.
TASKS = 256
WORD_END = "</w>"


class WordTokens:
    """Ids of texts by ``tokenizers``, with the ids of words kept from chunk to chunk.

    For tokenizers that read case alike and cut at white space and between letters and
    punctuation. New words of letters are read many at a time: the last id of each has a
    mark of its own (``WORD_END``) in the vocabulary.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_last[[i for word, i in vocabulary.items() if word.endswith(WORD_END)]] = True
        # words used since the last renewal, and those used before
        self.recent: dict[str, np.ndarray] = {}
        self.earlier: dict[str, np.ndarray] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _together(self, words: list[str]) -> list[np.ndarray] | None:
        """Ids of words that are one unit each; None if some are not."""
        (ids,) = self._encoded([" ".join(words)])
        ends = np.flatnonzero(self.is_last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return None
        return np.split(ids, ends[:-1])

    def _new(self, words: list[str]) -> dict[str, np.ndarray]:
        whole = [w for w in words if w.isalpha() and w == w.lower()]
        out: dict[str, np.ndarray] = {}
        for k in range(0, len(whole), 1000):
            part = whole[k : k + 1000]
            if (found := self._together(part)) is not None:
                out.update(zip(part, found, strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._encoded(rest), strict=True))
        return out

    def _words(self, words: list[str]) -> list[np.ndarray]:
        out = list(map(self.recent.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missing:
            if (ids := self.earlier.get(words[i])) is None:
                new.append(words[i])
            else:
                self.recent[words[i]] = ids
        self.recent.update(self._new(new))
        for i in missing:
            out[i] = self.recent[words[i]]
        if len(self.recent) > CACHED_WORDS:
            self.earlier, self.recent = self.recent, {}
        return out

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, words in word_chunks(texts, lower=True, limit=1 << 21, marks=True):
            if not len(words.starts):
                yield from (np.zeros(0, np.uint32) for _ in words.counts)
                continue
            coded = words.array().dictionary_encode()
            of_type = self._words(coded.dictionary.to_pylist())
            lengths = np.array([len(x) for x in of_type], np.int64)
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            which = coded.indices.to_numpy(zero_copy_only=False)
            ids = np.concatenate(of_type)[spread(first[which], lengths[which])]
            ends = np.concatenate(([0], np.cumsum(lengths[which])))[words.bounds]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield ids[a:b]


def assign(
    lengths: list[int], rooms: list[int], attention: float
) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces ``(document, start, length, sequence, offset)`` that fill all ``rooms``, and the rest
    ``(document, start, length)``. The documents must have as many tokens as the rooms at least.
    """
    room = np.array(rooms, np.int64)
    size = room.copy()
    cost = np.zeros(len(rooms))
    queue = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(queue)
    placed, rest = [], []
    open_ = int(room.sum())
    while queue:
        n, doc, start = heapq.heappop(queue)
        n = -n
        if not open_:
            rest.append((doc, start, n))
            continue
        k = int(np.argmin(np.where(room >= n, cost, np.inf)))
        take = n
        if room[k] < n:
            k = int(np.argmax(room))
            take = int(room[k])
            heapq.heappush(queue, (take - n, doc, start + take))
        placed.append((doc, start, take, k, int(size[k] - room[k])))
        room[k] -= take
        open_ -= take
        cost[k] += take + attention * take * take
    return placed, rest


class _Pack:
    def __init__(self, path: str, end_id: int, length: int, group: int, attention: float):
        self.path, self.end_id, self.length = path, end_id, length
        self.group, self.attention = group, attention

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(self.path)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        packer = _Sequences(self.length, self.attention, 0, part)
        # (id, ids that are not packed yet, their start in the document, its length)
        held: list[tuple[object, np.ndarray, int, int]] = []
        n = 0
        end = np.array([self.end_id], np.uint32)
        for batch in batches:
            keys = batch.column(0)
            for i, ids in enumerate(tokens.texts(batch.column(1))):
                ids = np.concatenate((ids, end))
                held.append((keys[i], ids, 0, len(ids)))
                n += len(ids)
                if n >= self.group:
                    held, out = packer.packed(held, False)
                    n = sum(len(x[1]) for x in held)
                    yield from out
        if held:
            held, out = packer.packed(held, False)
            yield from out
        if held:
            yield packer.rest(held)


class _Sequences:
    """Sequences of one task or group, numbered on their own."""

    def __init__(self, length: int, attention: float, level: int, part: int):
        self.length, self.attention, self.part = length, attention, part
        self.next = level << 56 | part << 24

    def packed(self, held, last: bool):
        """What does not fill sequences, and batches of pieces that do; with ``last`` all do."""
        n = sum(len(x[1]) for x in held)
        rooms = [self.length] * (n // self.length)
        if last:
            rooms += [1 << b for b in range(self.length.bit_length()) if n % self.length >> b & 1]
        placed, rest = assign([len(x[1]) for x in held], rooms, self.attention)
        out = []
        for i in range(0, len(placed), 4096):
            part = placed[i : i + 4096]
            rows = [(held[d][0], held[d][1][s : s + k], held[d][2] + s, held[d][3]) for d, s, k, _, _ in part]
            out.append(_batch(rows, [self.next + q for *_, q, _ in part], [o for *_, o in part]))
        self.next += len(rooms)
        left = [(held[d][0], held[d][1][s : s + k], held[d][2] + s, held[d][3]) for d, s, k in rest]
        return left, out

    def rest(self, held) -> pa.RecordBatch:
        """Rows without a sequence, numbered by task and place."""
        none = [None] * len(held)
        return _batch(held, none, none, [self.part] * len(held), list(range(len(held))))


def _batch(held, sequences, offsets, parts=None, places=None) -> pa.RecordBatch:
    none = [None] * len(held)
    long = pa.int64()
    columns = {
        "id": pa.array([key.as_py() for key, *_ in held], held[0][0].type),
        "start": pa.array([start for _, _, start, _ in held], long),
        "length": pa.array([len(ids) for _, ids, _, _ in held], long),
        "ids": pa.array([ids.astype("<u4").tobytes() for _, ids, _, _ in held], pa.binary()),
        "doc_tokens": pa.array([total for *_, total in held], long),
        "sequence_id": pa.array(sequences, long),
        "offset": pa.array(offsets, long),
        "part": pa.array(parts or none, long),
        "place": pa.array(places or none, long),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _pack_rests(length: int, attention: float, level: int, last: bool):
    """Packs the rests of some tasks, given with their number as ``group``, together."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("place", "ascending")]).combine_chunks()
        ids = [np.frombuffer(x, "<u4") for x in rows.column("ids").to_pylist()]
        held = list(
            zip(
                rows.column("id"),
                ids,
                rows.column("start").to_pylist(),
                rows.column("doc_tokens").to_pylist(),
                strict=True,
            )
        )
        packer = _Sequences(length, attention, level, rows.column("group")[0].as_py())
        held, out = packer.packed(held, last)
        return pa.Table.from_batches([*out, *([packer.rest(held)] if held else [])])

    return pack


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    length: int = 4096,
    group_tokens: int = 1 << 21,
    attention: float = ATTENTION,
) -> DataFrame:
    """One row for each piece: ``id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit ids. ``group_tokens`` bounds the tokens that a
    task holds, but for a longer document.
    """
    if group_tokens < length:
        raise ValueError("a group must fill a sequence at least")
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = f"id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    schema = f"{columns}, part long, place long"
    done = written(
        docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
            _Pack(tokenizer_path, end_id, length, group_tokens, attention), schema
        )
    )
    pieces, level = done.where("sequence_id IS NOT NULL"), 0
    while (last := done.where("part IS NOT NULL").agg(F.max("part")).first()[0]) is not None:
        level += 1
        rests = done.where("part IS NOT NULL").withColumn(
            "group", F.floor(F.col("part") / TASKS).cast("long")
        )
        done = written(
            rests.groupBy("group").applyInArrow(
                _pack_rests(length, attention, level, last < TASKS), schema
            )
        )
        pieces = pieces.unionByName(done.where("sequence_id IS NOT NULL"))
    return pieces.drop("part", "place")


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )

"""Which tokens of two tokenizers cover the same bytes, weighed by the whole corpus.

Text is read by a byte-level BPE vocabulary (A) and by a sentencepiece BPE model with byte
fallback (B). Byte offsets where tokens of both end cut a text into groups; each A token of
a group is linked with each B token of it. A pair of ids counts the documents that hold it
linked, over the whole corpus; the best pairs of an A id are those of the highest count.

Counting is external. A task gathers the pairs of its documents and spills them, sorted by A
and then B, as *runs*: a run is split by the low bits of the A id (*radix*), and each part is
written to the shared folder as zstd bytes, the pairs with their numbers of documents apart
from the documents themselves. The lists of pairs alone are shuffled by radix and merged by a
heap, at most ``fan_in`` at once; beyond that merged runs are merged again. A pair that all
documents hold is one entry for each run there, so no part is hot. In the order of the last
merge all pairs of an A id are together, which gives the highest count. Counts go back down
the merges to the runs, and each run turns them into sums for its own documents.

Tokens are looked up by distinct segments, many at a time. Segments are cut only where
neither tokenizer can hold bytes of both sides together: before a space that follows no white
space, and between an ASCII letter, digit and mark that stand together in no piece of B.

Defined cases: a text that is null, empty, or whose tokens of A or of B do not spell a space
and the text (U+2581 in a text is spelled as a space) has zeros and an empty listing; a
null id is a document as any other; rows equal in all columns are documents each; texts of
any length are read whole; an empty table gives an empty table; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import spread, text_buffers

#: Parts of a run. A fixed count: a part holds the pairs of one A id in so many.
RADIX = 64
#: Segments of a run, and bytes of its distinct segments, after which it is spilled.
RUN_SEGMENTS = 1 << 20
CACHED_SEGMENTS, CACHED_BYTES = 200_000, 1 << 24
#: Runs that one merge reads.
FAN_IN = 256
#: Distinct segments that are read as one text.
TOGETHER = 2048

_PLACE = np.uint64(32)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row, and where each part starts and how long it is."""
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


class _Vocabulary:
    """Bytes of each id."""

    def __init__(self, parts: list[bytes]):
        self.data, self.starts, self.lengths = _joined(parts)
        self.names = [str(i).encode() for i in range(len(parts))]

    def spelled(self, ids: np.ndarray) -> bytes:
        return self.data[spread(self.starts[ids], self.lengths[ids])].tobytes()


class Tokenizers:
    """Both tokenizers, and the cuts that neither of them sees."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte = Tokenizer.from_file(byte_path)
        self.byte.encode_special_tokens = True
        vocabulary = self.byte.get_vocab()
        of_byte = _byte_letters()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in of_byte for c in token):
                tokens[i] = bytes(of_byte[c] for c in token)
        self.a = _Vocabulary(tokens)

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.piece.id_to_piece(i) for i in range(self.piece.get_piece_size())]
        plain = [not self.piece.is_byte(i) for i in range(len(names))]
        self.b = _Vocabulary(
            [
                n.replace("▁", " ").encode() if p else bytes([int(n[3:5], 16)])
                for n, p in zip(names, plain, strict=True)
            ]
        )
        #: Pairs of ASCII characters that some piece of B holds next to each other.
        beside = np.zeros((128, 128), bool)
        spaced = False
        for name in (n for n, p in zip(names, plain, strict=True) if p):
            for x, y in zip(name, name[1:], strict=False):
                spaced |= y == "▁" != x
                if x < "\x80" > y:
                    beside[ord(x), ord(y)] = True
        if spaced or any("\n" in n for n in names):
            raise ValueError("a piece holds a space after another character, or a line break")
        if len(tokens) * len(names) >= 1 << 32:
            raise ValueError("the vocabularies have 2**32 pairs or more")
        kinds = np.zeros(128, np.int8)
        kinds[[*range(65, 91), *range(97, 123)]] = 1
        kinds[48:58] = 2
        kinds[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3
        differ = (kinds[:, None] != kinds[None, :]) & (kinds[:, None] > 0) & (kinds[None, :] > 0)
        self.cut = np.zeros((256, 256), bool)
        self.cut[:128, :128] = differ & ~beside

    def segments(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Places of the UTF-8 bytes where a segment starts; texts start at ``begins``."""
        before, here = data[:-1], data[1:]
        visible = (before > 32) & (before != 127)
        high = np.flatnonzero((before >= 128) & (here == 32))
        if len(high):
            # U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000, which are or may be white space
            one = data[np.maximum(high - 1, 0)]
            two = data[np.maximum(high - 2, 0)]
            last = data[high]
            white = (one == 0xC2) & ((last == 0x85) | (last == 0xA0))
            white |= (two == 0xE1) & (one == 0x9A) | (two == 0xE2) & ((one == 0x80) | (one == 0x81))
            white |= (two == 0xE3) & (one == 0x80)
            visible[high[white]] = False
        starts = np.zeros(len(data), bool)
        starts[1:] = (visible & (here == 32)) | self.cut[before, here]
        starts[begins] = True
        return np.flatnonzero(starts)

    def _alone(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self.byte.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.int64), self._pieces("\n" + text)[2:]

    def _pieces(self, text: str) -> np.ndarray:
        return np.array(self.piece.encode(text), np.int64)

    def read(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for each segment; None where they spell something else."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(segments)
        calm, odd = [], []
        for i, s in enumerate(segments):
            white = s[-1].isspace() or s[0].isspace() and (s[0] != " " or s[1].isspace())
            (odd if white else calm).append(i)
        for k in range(0, len(calm), TOGETHER):
            part = calm[k : k + TOGETHER]
            found = self._together([segments[i] for i in part])
            if found is None:
                odd += part
            else:
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids
        for i in odd:
            a, b = self._alone(segments[i])
            data = segments[i].encode()
            if self.a.spelled(a) == data == self.b.spelled(b):
                out[i] = a, b
        return out

    def _together(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Read as lines of one text; None if that does not spell the lines."""
        parts = [("\n" + s).encode() for s in segments]
        data = b"".join(parts)
        starts = np.cumsum([len(p) for p in parts]) - [len(p) for p in parts]
        text = data.decode()
        # the first piece of B is the space that it adds, which the line break keeps apart
        a, b = self.byte.encode_batch_fast([text], add_special_tokens=False)[0].ids, self._pieces(text)
        a = np.array(a, np.int64)
        if self.a.spelled(a) != data or self.b.spelled(b) != b" " + data:
            return None
        b = b[1:]
        split = []
        for ids, vocabulary in ((a, self.a), (b, self.b)):
            lengths = vocabulary.lengths[ids]
            begins = np.cumsum(lengths) - lengths
            at = np.searchsorted(begins, starts)
            if at[-1] >= len(begins) or (begins[at] != starts).any() or (lengths[at] != 1).any():
                return None
            split.append([x[1:] for x in np.split(ids, at[1:])])
        return list(zip(*split, strict=True))


class _Segments:
    """What the distinct segments of a run hold, by the number that each has got."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.width = len(tokenizers.b.names)
        self.renew()

    def renew(self) -> None:
        self.number: dict[str, int] = {}
        self.bytes = 0
        self.listing: list[bytes] = []
        # for each segment: tokens of A and B, groups, links, whether it is spelled right
        self.counts = [np.zeros((0, 5), np.int64)]
        self.n_pairs = [np.zeros(0, np.int64)]
        # for each pair of a segment: the pair, and how often it is linked there
        self.pairs = [np.zeros(0, np.int64)]
        self.often = [np.zeros(0, np.int64)]

    def numbers(self, segments: list[str]) -> np.ndarray:
        new = [s for s in segments if s not in self.number]
        if new:
            self._add(new)
        return np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))

    def _add(self, new: list[str]) -> None:
        found = self.tokenizers.read(new)
        first = len(self.listing)
        self.number.update(zip(new, range(first, first + len(new)), strict=True))
        self.bytes += sum(map(len, new))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        good = np.array([f is not None for f in found])
        found = [f or empty for f in found]
        n_a = np.array([len(a) for a, _ in found])
        n_b = np.array([len(b) for _, b in found])
        a = np.concatenate([a for a, _ in found])
        b = np.concatenate([b for _, b in found])
        a_names, b_names = self.tokenizers.a.names, self.tokenizers.b.names
        # ends in one row of bytes: segments follow each other, and their ends are common
        a_ends = np.cumsum(self.tokenizers.a.lengths[a])
        b_ends = np.cumsum(self.tokenizers.b.lengths[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_stop = np.searchsorted(a_ends, common) + 1
        b_stop = np.searchsorted(b_ends, common) + 1
        of_a = np.diff(a_stop, prepend=0)
        of_b = np.diff(b_stop, prepend=0)
        group_stop = np.searchsorted(a_stop, np.cumsum(n_a), side="right")
        n_groups = np.diff(group_stop, prepend=0)
        group_owner = np.repeat(np.arange(len(new)), n_groups)
        links = of_a * of_b
        n_links = np.bincount(group_owner, links, len(new)).astype(np.int64)
        # each A token of a group with each B token of it
        nth = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
        wide = np.repeat(of_b, links)
        left = a[np.repeat(a_stop - of_a, links) + nth // wide]
        right = b[np.repeat(b_stop - of_b, links) + nth % wide]
        pair = left * self.width + right
        owner = np.repeat(group_owner, links)
        order = np.lexsort((pair, owner))
        owner, pair = owner[order], pair[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(fresh)
        self.pairs.append(pair[at])
        self.often.append(np.diff(at, append=len(pair)))
        self.n_pairs.append(np.bincount(owner[at], minlength=len(new)))
        self.counts.append(np.stack([n_a, n_b, n_groups, n_links, good], 1))
        i = j = 0
        a, b = a.tolist(), b.tolist()
        texts = []
        for s, t in zip(a_stop.tolist(), b_stop.tolist(), strict=True):
            if s == i + 1 and t == j + 1:
                texts.append(a_names[a[i]] + b"|" + b_names[b[j]])
            else:
                texts.append(
                    b",".join([a_names[x] for x in a[i:s]])
                    + b"|"
                    + b",".join([b_names[x] for x in b[j:t]])
                )
            i, j = s, t
        i = 0
        for s in group_stop.tolist():
            self.listing.append(texts[i] if s == i + 1 else b";".join(texts[i:s]))
            i = s

    def tables(self) -> tuple[np.ndarray, ...]:
        for name in ("counts", "n_pairs", "pairs", "often"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        return self.counts[0], self.n_pairs[0], self.pairs[0], self.often[0]


def _press(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _whole(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _entries(data: bytes, block: int = 1 << 14) -> Iterator[int]:
    """Entries of a run, some at a time."""
    with zstandard.ZstdDecompressor().stream_reader(data) as stream:
        while part := stream.read(8 * block):
            yield from np.frombuffer(part, np.uint64).tolist()


def _merged(runs: list[bytes]) -> np.ndarray:
    """One sorted run of all, counts of a pair added. An entry is ``pair << 32 | count``.

    Counts above the 32 bits are carried in further entries of the pair.
    """
    out: list[int] = []
    pair, total, most = -1, 0, (1 << 32) - 1
    for entry in heapq.merge(*map(_entries, runs)):
        if entry >> 32 == pair:
            total += entry & most
        else:
            while total:
                out.append(pair << 32 | min(total, most))
                total -= min(total, most)
            pair, total = entry >> 32, entry & most
    while total:
        out.append(pair << 32 | min(total, most))
        total -= min(total, most)
    return np.array(out, np.uint64)


def _totals(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a merged run, and their counts."""
    pairs = (run >> _PLACE).astype(np.int64)
    at = np.flatnonzero(np.diff(pairs, prepend=-1))
    counts = (run & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return pairs[at], np.add.reduceat(counts, at) if len(at) else counts


def _answers(pairs: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """``2 * count``, and 1 more for the best pairs of an A id. ``pairs`` are in order of A."""
    if not len(pairs):
        return counts
    at = np.flatnonzero(np.diff(pairs // width, prepend=-1))
    most = np.repeat(np.maximum.reduceat(counts, at), np.diff(at, append=len(pairs)))
    return 2 * counts + (counts == most)


def _handed(runs, pairs: np.ndarray, answers: np.ndarray) -> list[bytes]:
    """The answers to each run's own pairs, in their order."""
    out = []
    for run in runs:
        own, _ = _totals(_whole(run))
        out.append(_press(answers[np.searchsorted(pairs, own)]))
    return out


class _Spill:
    def __init__(self, byte_path, piece_path, id_type, run_segments, radix):
        self.paths, self.id_type = (byte_path, piece_path), id_type
        self.run_segments, self.radix = run_segments, radix

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(*self.paths)
        segments = _Segments(tokenizers)
        context = TaskContext.get()
        run = context.partitionId() << 32 if context else 0
        held, n = [], 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            texts = texts.fill_null("").cast(pa.large_string())
            texts = pc.binary_replace_slice(texts, start=0, stop=0, replacement=" ")
            data, offsets = text_buffers(texts)
            start = 0
            while start < len(texts):
                stop = int(np.searchsorted(offsets, offsets[start] + (1 << 22), side="right")) - 1
                stop = min(max(stop, start + 1), len(texts))
                numbers, bounds = self._numbered(tokenizers, segments, data, offsets[start : stop + 1])
                held.append((keys.slice(start, stop - start), numbers, bounds))
                n += len(numbers)
                start = stop
                if n >= self.run_segments or segments.bytes > CACHED_BYTES:
                    yield self._run(run, segments, held)
                    held, n, run = [], 0, run + 1
                    if len(segments.number) > CACHED_SEGMENTS or segments.bytes > CACHED_BYTES:
                        segments.renew()
        if held:
            yield self._run(run, segments, held)

    def _numbered(self, tokenizers, segments, data, offsets):
        """Segment numbers of some texts, and the range of each text in them."""
        first = offsets[0]
        part = data[first : offsets[-1]]
        begins = offsets[:-1] - first
        starts = tokenizers.segments(part, begins)
        ends = np.append(starts[1:], len(part)).astype(np.int64)
        places = pa.py_buffer(np.append(starts, ends[-1]).astype(np.int64))
        array = pa.LargeStringArray.from_buffers(len(starts), places, pa.py_buffer(part.tobytes()))
        coded = array.dictionary_encode()
        of_type = segments.numbers(coded.dictionary.to_pylist())
        numbers = of_type[coded.indices.to_numpy(zero_copy_only=False)]
        return numbers.astype(np.int32), np.append(np.searchsorted(starts, begins), len(starts))

    def _run(self, run, segments, held) -> pa.RecordBatch:
        counts, n_pairs, pairs, often = segments.tables()
        listing = segments.listing.__getitem__
        numbers = np.concatenate([x for _, x, _ in held])
        sizes = np.concatenate([np.diff(x) for _, _, x in held])
        n_docs = len(sizes)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(n_docs), sizes)
        of_doc = np.stack([np.add.reduceat(c[numbers], ends - sizes) for c in counts.T], 1)
        # a text of no bytes is the added space alone
        alone = (sizes == 1) & (numbers[ends - sizes] == segments.number.get(" ", -1))
        good = (of_doc[:, 4] == sizes) & ~alone
        of_doc[~good] = 0
        digests = []
        for d in range(n_docs):
            text = b""
            if good[d]:
                text = b";".join(map(listing, numbers[ends[d] - sizes[d] : ends[d]].tolist()))
            digests.append(hashlib.sha256(text).hexdigest() if good[d] else "")

        inside = good[owner]
        held_in = np.sort(owner[inside].astype(np.int64) << 32 | numbers[inside])
        at = np.flatnonzero(np.diff(held_in, prepend=-1))
        times = np.diff(at, append=len(held_in))
        doc, segment = held_in[at] >> 32, held_in[at] & 0xFFFFFFFF
        each = n_pairs[segment]
        where = spread((np.cumsum(n_pairs) - n_pairs)[segment], each)
        pair, doc = pairs[where], np.repeat(doc, each)
        links = often[where] * np.repeat(times, each)
        # the place of a pair in the order of parts, A and B
        a = pair // segments.width
        high = -(-len(segments.tokenizers.a.names) // self.radix)
        code = (a % self.radix * high + a // self.radix) * segments.width + pair % segments.width
        code = code.astype(np.uint64) << _PLACE | doc.astype(np.uint64)
        order = np.argsort(code)
        code = code[order]
        fresh = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        links = np.add.reduceat(links[order], fresh) if len(fresh) else links
        pair, doc = pair[order[fresh]], doc[order[fresh]]
        low = pair // segments.width % self.radix

        rows = {name: [] for name in ("radix", "pairs", "docs")}
        bounds = np.searchsorted(low, np.arange(self.radix + 1))
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            i, j = bounds[r], bounds[r + 1]
            own = pair[i:j]
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            in_docs = np.diff(begin, append=j - i)
            entries = own[begin].astype(np.uint64) << _PLACE | in_docs.astype(np.uint64)
            rows["radix"].append(r)
            rows["pairs"].append(_press(entries))
            rows["docs"].append(_press(np.concatenate((doc[i:j], links[i:j]))))
        parts = len(rows["radix"])
        total = n_docs + parts
        keys = pa.concat_arrays([k for k, _, _ in held])
        blank = [None] * parts
        none = [None] * n_docs
        columns = [
            pa.array([run] * total, pa.int64()),
            pa.array([*range(n_docs), *blank], pa.int64()),
            pa.concat_arrays([keys, pa.nulls(parts, keys.type)]),
            *[pa.array([*of_doc[:, k].tolist(), *blank], pa.int64()) for k in range(4)],
            pa.array([*digests, *blank], pa.string()),
            pa.array(none + rows["radix"], pa.int32()),
            pa.array(none + rows["pairs"], pa.binary()),
            pa.array(none + rows["docs"], pa.binary()),
        ]
        names = ["run", "place", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "radix", "pairs", "docs"])


def spill(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_segments: int = RUN_SEGMENTS,
    radix: int = RADIX,
) -> DataFrame:
    """The written runs: a row for each document (``place`` in its run, counts, listing's digest)
    and a row for each part of a run (``radix, pairs, docs``).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    return written(
        docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
            _Spill(byte_path, piece_path, id_type, run_segments, radix),
            f"run long, place long, id {id_type}, n_a long, n_b long, n_groups long, n_links long,"
            " groups_sha256 string, radix int, pairs binary, docs binary",
        )
    )


def _merge_up(rows: pd.DataFrame) -> pd.DataFrame:
    run = _press(_merged(list(rows["pairs"])))
    return pd.DataFrame({"radix": rows["radix"][:1], "node": rows["parent"][:1], "pairs": [run]})


def _answer_top(width: int):
    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = _totals(_merged(list(rows["pairs"])))
        handed = _handed(rows["pairs"], pairs, _answers(pairs, counts, width))
        return rows[["radix", "node"]].assign(answers=handed)

    return answer


def _answer_below(children: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    (run,), (answers,) = parents["pairs"], parents["answers"]
    handed = _handed(children["pairs"], _totals(_whole(run))[0], _whole(answers, np.int64))
    return children[["radix", "node"]].assign(answers=handed)


def _levels(runs: DataFrame, fan_in: int) -> list[DataFrame]:
    """``radix, node, pairs`` of the runs and of the merges above them, and the ``parent`` that
    each goes to; the last level is at most ``fan_in`` runs for each part.
    """
    if fan_in < 2:
        raise ValueError("a merge must read two runs at least")
    level = runs.where("radix IS NOT NULL").select("radix", F.col("run").alias("node"), "pairs")
    n = level.select("node").distinct().count()
    levels = []
    while n > fan_in:
        n = -(-n // fan_in)
        level = level.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(n)))
        levels.append(level)
        level = written(
            level.groupBy("radix", "parent").applyInPandas(
                _merge_up, "radix int, node long, pairs binary"
            )
        )
    return [*levels, level]


def answers(runs: DataFrame, width: int, *, fan_in: int = FAN_IN) -> DataFrame:
    """``radix, node, answers``: for each part of a run (``node``) what :func:`_answers` tells
    of its pairs, counted over all runs. ``width`` is the number of B ids.
    """
    *below, level = _levels(runs, fan_in)
    found = level.groupBy("radix").applyInPandas(
        _answer_top(width), "radix int, node long, answers binary"
    )
    for children in reversed(below):
        above = level.join(found, ["radix", "node"])
        found = written(
            children.groupBy("radix", "parent")
            .cogroup(above.groupBy("radix", "node"))
            .applyInPandas(_answer_below, "radix int, node long, answers binary")
        )
        level = children
    return found


def _contributions(parts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Sums over the links of each document of one run."""
    answered = dict(zip(found["radix"], found["answers"], strict=True))
    best: np.ndarray = np.zeros(0, np.int64)
    total = best
    for radix, pairs, docs in zip(parts["radix"], parts["pairs"], parts["docs"], strict=True):
        in_docs = (_whole(pairs) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc, links = _whole(docs, np.int64).reshape(2, -1)
        answer = np.repeat(_whole(answered[radix], np.int64), in_docs)
        size = int(doc.max()) + 1
        if size > len(best):
            best, total = (np.append(x, np.zeros(size - len(x), np.int64)) for x in (best, total))
        np.add.at(best, doc, links * (answer & 1))
        np.add.at(total, doc, links * (answer >> 1))
    return pd.DataFrame(
        {"run": parts["run"].iloc[0], "place": np.arange(len(best)), "n_best": best, "count_sum": total}
    )


def align(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_segments: int = RUN_SEGMENTS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    runs = spill(
        docs, byte_path, piece_path, id_col=id_col, text_col=text_col, run_segments=run_segments
    )
    found = answers(runs, width, fan_in=fan_in).withColumnRenamed("node", "run")
    parts = runs.where("radix IS NOT NULL").select("run", "radix", "pairs", "docs")
    sums = (
        parts.groupBy("run")
        .cogroup(found.groupBy("run"))
        .applyInPandas(_contributions, "run long, place long, n_best long, count_sum long")
    )
    rows = runs.where("place IS NOT NULL").drop("radix", "pairs", "docs")
    none = F.lit(0).cast("long")
    return rows.join(sums, ["run", "place"], "left").select(
        "id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
        "groups_sha256",
    )


def pair_counts(runs: DataFrame, width: int, *, fan_in: int = FAN_IN) -> DataFrame:
    """``a, b, n_docs, best`` of all pairs of ids in the runs of :func:`spill`."""

    def listed(rows: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = _totals(_merged(list(rows["pairs"])))
        best = (_answers(pairs, counts, width) & 1).astype(bool)
        a, b = pairs // width, pairs % width
        return pd.DataFrame({"a": a, "b": b, "n_docs": counts, "best": best})

    return _levels(runs, fan_in)[-1].groupBy("radix").applyInPandas(
        listed, "a long, b long, n_docs long, best boolean"
    )

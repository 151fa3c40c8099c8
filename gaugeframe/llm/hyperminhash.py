"""Near duplicates by HyperMinHash.

Each document's word shingles are hashed into 128 buckets by their first bits. A bucket
keeps its smallest hash as a register of 16 bits: the number of leading zeros and ten bits
after them. Empty buckets borrow the register of another bucket, found along a fixed
random order, so that short texts compare as well as long ones. Bands of four registers
propose pairs; the share of equal registers, corrected for those equal by chance,
estimates the Jaccard similarity of a pair; pairs that may reach the threshold are
compared on their full shingle sets.

Texts with equal sets are one class first, known by the digest of its set, so copies cost
one row each. Within a band's
bucket pairs are proposed in rounds, all with one member, chosen anew each round. Only pairs
across components are ever compared, so a large group of copies costs about one comparison
for each member. What buckets then still hold in several components is compared in full:
small buckets as pairs, crowded ones in blocks, where a task takes two blocks of texts and
lets out only links. So every link between two components that a band proposes is found.

Two texts at the threshold share no band with a chance of (1 - 0.75**4)**32, five in a
million; beyond it far less.

Defined cases: a null text, or one without words, has an empty set and stays alone; a text
of fewer words than a shingle is one shingle; rows with the same id share its component; a
null id is linked by similarity like any other, and is no component's name: the component of
rows without an id alone is null; an empty table gives an empty table; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import EXACT_TIMES, ref
from .components import components
from .storage import written
from .words import chunks, mixed, shingle_hashes, spread, word_chunks

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BAND = 4
STAR_ROUNDS = 1
#: A bucket of more members than this is settled in blocks, of so many rows and bytes of text.
CROWD = 64
BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 22
#: Bytes of text whose sets are in memory at once.
SKETCH_BYTES = 1 << 22
#: Standard errors below the threshold at which an estimate rules a pair out.
MARGIN = 5.5
_FIRST = (np.arange(REGISTERS, dtype=np.uint64)) << np.uint64(64 - BUCKET_BITS)
_ORDER = np.argsort(
    np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1
).astype(np.int64)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    for _, _, words in word_chunks(texts, lower=True):
        hashes = words.hashes()
        shingles, first = shingle_hashes(words, hashes, size)
        cuts = np.searchsorted(first, words.bounds)
        for i, n in enumerate(words.counts):
            if n >= size:
                yield np.unique(shingles[cuts[i] : cuts[i + 1]])
            elif n:
                short = np.uint64(n)
                for h in hashes[words.bounds[i] : words.bounds[i + 1]]:
                    short = mixed(np.array([short], np.uint64) + h)[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets: one row of 16-bit numbers each."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = np.zeros((len(sets), REGISTERS), bool)
    for i, hashes in enumerate(sets):
        at = np.searchsorted(hashes, _FIRST)
        have = np.append(at[1:], len(hashes)) > at
        least = hashes[at[have]] << np.uint64(BUCKET_BITS)
        # the exponent of the smallest hash is its number of leading zeros
        zeros = np.where(least > 0, 64 - np.frexp(least.astype(np.float64))[1], 63)
        zeros = np.clip(zeros, 0, 63).astype(np.uint64)
        rest = (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(
            64 - MANTISSA_BITS
        )
        out[i, have] = ((zeros << np.uint64(MANTISSA_BITS)) | rest).astype(np.uint16)
        full[i] = have
    own = out.copy()
    rows, columns = np.nonzero(~full)
    for step in range(REGISTERS):
        if not len(rows):
            break
        source = _ORDER[columns, step]
        found = full[rows, source]
        out[rows[found], columns[found]] = own[rows[found], source[found]]
        rows, columns = rows[~found], columns[~found]
    return out


def chance_of_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that registers of different hashes are equal, for sets of sizes a and b.

    The published approximation of the expected collisions, for one register.
    """
    ratio = np.maximum(a, b) / np.maximum(np.minimum(a, b), 1)
    return 0.169919487159739 * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2


def _digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _digest_of(size: int):
    """A function of a text column: the digest of each text's set, null for an empty one."""

    def digests(texts: pa.Array) -> pa.Array:
        return pa.array([_digest(s) for s in shingle_sets(texts, size)], pa.binary())

    return F.arrow_udf(digests, "binary")


class _Sketch:
    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in chunks(texts, SKETCH_BYTES):
                sets = list(shingle_sets(texts.slice(i, j - i), self.size))
                rows = iter(registers([s for s in sets if len(s)]).astype("<u2"))
                regs = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array(regs, pa.binary()),
                    ],
                    names=["id", "n", "digest", "regs"],
                )


class _Likely:
    """Pairs whose estimate does not rule out the threshold."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS)
                for k in (2, 3)
            )
            sizes = [batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)]
            chance = chance_of_equal(*sizes)
            equal = (a == b).mean(axis=1)
            estimate = (equal - chance) / (1 - chance)
            t = self.threshold
            # short sets have fewer distinct registers than buckets
            error = np.sqrt(t * (1 - t) / np.minimum(REGISTERS, np.maximum(*sizes)))
            keep = pa.array(estimate >= t - MARGIN * error)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"]
            )


class _Linked:
    """Pairs that reach the threshold on their full sets."""

    def __init__(self, size: int, percent: int):
        self.size, self.percent = size, percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pairs = zip(
                    shingle_sets(part.column(2), self.size),
                    shingle_sets(part.column(3), self.size),
                    strict=True,
                )
                for x, y in pairs:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= self.percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"]
            )


def _block_links(rows: list[tuple], size: int, percent: int) -> Iterator[tuple]:
    """Linked pairs of different components among ``rows (first, second, id, c, text)``.

    Pairs are those of a row marked ``first`` with one marked ``second``.
    """
    sets = list(shingle_sets(pa.array([r[4] for r in rows], pa.string()), size))
    second = [k for k, r in enumerate(rows) if r[1]]
    lengths = np.array([len(sets[k]) for k in second])
    hashes = np.concatenate([sets[k] for k in second])
    owner = np.repeat(np.arange(len(second)), lengths)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    for k, row in enumerate(rows):
        if not row[0]:
            continue
        low, high = (np.searchsorted(hashes, sets[k], side) for side in ("left", "right"))
        both = np.bincount(owner[spread(low, high - low)], minlength=len(second))
        linked = 100 * both >= percent * (len(sets[k]) + lengths - both)
        for j in np.flatnonzero(linked):
            other = rows[second[j]]
            if other[3] != row[3]:
                yield min(row[2], other[2]), max(row[2], other[2])


class _Blocks:
    """Linked pairs of all blocks; rows ``(block, first, second, id, c, text)`` come sorted by block."""

    def __init__(self, size: int, percent: int):
        self.size, self.percent = size, percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != block:
                    yield from self._found(held)
                    block, held = row[0], []
                held.append(row[1:])
        yield from self._found(held)

    def _found(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if any(r[0] for r in rows) and any(r[1] for r in rows):
            pairs = sorted(set(_block_links(rows, self.size, self.percent)))
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.binary()) for x in zip(*pairs, strict=True)], names=["a", "b"]
                )


def _crowds(members: DataFrame, texts: DataFrame, *, size: int, percent: int) -> DataFrame:
    """``a, b``: all links across components in crowded buckets ``members(key, id, c)``.

    Documents whose crowded buckets overlap are one crowd. A crowd is cut into blocks of
    bounded size, and each pair of blocks is compared within one task, on full sets; only
    links leave it.
    """
    heads = members.groupBy("key").agg(F.min("id").alias("a"))
    edges = members.join(heads, "key").select("a", F.col("id").alias("b"))
    crowd = components(edges)
    rows = written(
        texts.join(members.select("id", "c").distinct(), "id")
        .join(crowd.select("id", F.col("c").alias("crowd")), "id")
        .select("crowd", "id", "c", "text")
    )
    sizes = rows.groupBy("crowd").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)
        ).alias("blocks")
    )
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    other = F.col("other")
    block = F.concat_ws("/", F.hex("crowd"), F.least("own", other), F.greatest("own", other))
    dealt = (
        rows.join(sizes, "crowd")
        .withColumn("own", own)
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select(
            block.alias("block"),
            (F.col("own") <= other).alias("first"),
            (F.col("own") >= other).alias("second"),
            "id",
            "c",
            "text",
        )
    )
    return (
        dealt.repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_Blocks(size, percent), "a binary, b binary")
    )


def _labels(members: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return members.withColumn("c", F.col("id"))
    return members.join(known, "id", "left").withColumn("c", F.coalesce("c", "id"))


def _empty(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} binary" for n in names))


def _class_texts(plain: DataFrame, sketches: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``id, text``: a text of each class of ``wanted(id, doc)``, by digest ``id`` and smallest id ``doc``.

    An id of one row tells its text; texts of repeated ids, and of rows without an id, are told
    apart by their digests.
    """
    ids = sketches.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("doc"))
    repeated = written(ids.agg(F.count("*").alias("k")).where("k > 1").select("doc"))
    plain = plain.select(F.col("id").alias("doc"), "text")
    single = plain.join(wanted.where("doc IS NOT NULL").join(repeated, "doc", "left_anti"), "doc")
    single = single.select("id", "text")
    unnamed = wanted.where("doc IS NULL")
    if repeated.isEmpty() and unnamed.isEmpty():
        return single
    apart = plain.join(repeated, "doc", "left_semi").unionByName(plain.where("doc IS NULL"))
    asked = wanted.join(repeated, "doc", "left_semi").select("id").unionByName(unnamed.select("id"))
    told = (
        apart.select(_digest_of(size)("text").alias("id"), "text")
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("text").alias("text"))
        .join(asked, "id", "left_semi")
    )
    return single.unionByName(told)


def linked_components(
    plain: DataFrame, rows: DataFrame, reps: DataFrame, *, size: int, percent: int, star_rounds: int
) -> DataFrame:
    """``id, c`` of the classes that are linked, by digest.

    ``reps(id, doc, n, regs)`` are distinct sets with their digest and smallest id, ``rows`` the
    sketches of all rows of ``plain(id, text)``.
    """
    spark = plain.sparkSession
    bands = F.array(
        *[
            F.xxhash64(F.lit(i), F.substring("regs", 2 * BAND * i + 1, 2 * BAND))
            for i in range(REGISTERS // BAND)
        ]
    )
    banded = reps.select("id", F.explode(bands).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    members = written(banded.join(shared, "key"))
    proposed = members.select("id").distinct()
    sketches = written(reps.join(proposed, "id"))
    texts = written(_class_texts(plain, rows, sketches.select("id", "doc"), size))
    tested = _empty(spark, "a", "b")
    known = None
    for turn in range(star_rounds + 1):
        labelled = written(_labels(members, known))
        if turn < star_rounds:
            pick = F.struct(F.xxhash64(F.lit(turn), "id"), "id", "c")
            chosen = labelled.groupBy("key").agg(F.min(pick).alias("p"))
            chosen = chosen.select("key", F.col("p.id").alias("id0"), F.col("p.c").alias("c0"))
            across = labelled.join(chosen, "key").where("c <> c0")
            pairs = across.select(
                F.least("id", "id0").alias("a"), F.greatest("id", "id0").alias("b")
            )
        else:
            # what is left: pairs of small buckets as rows, crowded ones within tasks
            several = labelled.groupBy("key").agg(
                F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")
            )
            several = several.where("lo < hi").select("key", (F.col("k") > CROWD).alias("crowd"))
            rest = written(labelled.join(several, "key"))
            crowded = written(
                _crowds(rest.where("crowd"), texts, size=size, percent=percent)
            )
            few = rest.where("not crowd").select("key", "id", "c")
            other = few.select("key", F.col("id").alias("id0"), F.col("c").alias("c0"))
            across = few.join(other, "key").where("c < c0")
            pairs = across.select(
                F.least("id", "id0").alias("a"), F.greatest("id", "id0").alias("b")
            )
        pairs = pairs.distinct().join(tested, ["a", "b"], "left_anti")
        a, b = (
            sketches.select(
                F.col("id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n").alias(f"n{x}")
            )
            for x in "ab"
        )
        fit = F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100
        likely = written(
            pairs.join(a, "a")
            .join(b, "b")
            .where(fit)
            .select("a", "b", "ra", "rb", "na", "nb")
            .mapInArrow(_Likely(percent / 100), "a binary, b binary")
        )
        ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        links = written(
            likely.join(ta, "a")
            .join(tb, "b")
            .select("a", "b", "ta", "tb")
            .mapInArrow(_Linked(size, percent), "a binary, b binary")
        )
        if turn == star_rounds:
            links = links.unionByName(crowded)
        tested = tested.unionByName(likely)
        stars = links if known is None else links.unionByName(
            known.select(F.col("c").alias("a"), F.col("id").alias("b"))
        )
        known = written(components(stars))
    return known


def _grouped(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 75,
    star_rounds: int = STAR_ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """``id, n, digest, regs`` of each row, and ``digest, root, c`` of the sets of several rows or with a link.

    ``root`` is the digest that names the group of linked sets, ``c`` the smallest id in it.
    """
    if not 50 <= percent <= 100 or not math.isfinite(size) or size < 1:
        raise ValueError("percent must be from 50 to 100 and size at least 1")
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    sketches = written(
        plain.mapInArrow(_Sketch(size), f"id {kind}, n long, digest binary, regs binary")
    )
    some = sketches.where(F.col("digest").isNotNull())
    classes = written(
        some.groupBy("digest").agg(
            F.min("id").alias("id"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("regs").alias("regs"),
        )
    )
    reps = classes.select(F.col("digest").alias("id"), F.col("id").alias("doc"), "n", "regs")
    known = linked_components(
        plain, sketches, reps, size=size, percent=percent, star_rounds=star_rounds
    ).select(F.col("id").alias("digest"), F.col("c").alias("root"))
    # only classes of several rows or with a link change a component
    changed = (
        classes.select("digest", "copies", "id")
        .join(known, "digest", "left")
        .where("copies > 1 or root is not null")
        .select("digest", "id", F.coalesce("root", "digest").alias("root"))
    )
    least = changed.groupBy("root").agg(F.min("id").alias("c"))
    changed = written(changed.join(least, "root").select("digest", "root", "c"))
    return sketches, changed


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``id, n_shingles, component_id`` of each row of ``docs``.

    ``component_id`` is the smallest id that links of at least ``percent`` per cent
    similarity lead to. Options are those of ``_grouped``.
    """
    sketches, changed = _grouped(docs, **options)
    grouped = sketches.join(changed, "digest", "left").select(
        "id", "n", "digest", F.coalesce("root", "digest").alias("root"), F.coalesce("c", "id").alias("c")
    )
    result = lambda c: grouped.select("id", F.col("n").alias("n_shingles"), c.alias("component_id"))
    # groups that hold rows of one id share a component
    some = sketches.where("id is not null and digest is not null")
    apart = some.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    apart = written(apart.where("lo < hi").select("id"))
    if apart.isEmpty():
        return result(F.col("c"))
    held = grouped.where("digest is not null").join(apart, "id", "left_semi").select("id", "root").distinct()
    first = held.groupBy("id").agg(F.min("root").alias("a"))
    united = components(held.join(first, "id").select("a", F.col("root").alias("b")))
    united = united.select(F.col("id").alias("root"), F.col("c").alias("united"))
    smallest = grouped.join(united, "root").groupBy("united").agg(F.min("c").alias("shared"))
    shared = united.join(smallest, "united").select("root", "shared")
    grouped = grouped.join(shared, "root", "left")
    return result(F.coalesce("shared", "c"))


def keep_one(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    **options,
) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id.

    Rows are dropped by id and text, so that a row whose id is null or repeated goes only
    with its own text. Of rows that have no id in their component one stays. Rows of
    the smallest id that differ in columns besides the text stay each. Texts without words
    stay.
    """
    sketches, changed = _grouped(docs, id_col=id_col, text_col=text_col, size=size, **options)
    several = written(sketches.groupBy("id").agg(F.count("*").alias("k")).where("id is null or k > 1"))
    repeated = several.where("id is not null").select(F.col("id").alias("_dropped"))
    # an id of one row tells its text
    dropped = sketches.join(changed, "digest").where("id <> c").select(F.col("id").alias("_dropped"))
    dropped = dropped.unionByName(repeated).distinct()
    single = docs.where(docs[id_col].isNotNull()).join(
        dropped, docs[id_col] == dropped["_dropped"], "left_anti"
    )
    if several.isEmpty():
        return single
    rest = docs.where(docs[id_col].isNull()).unionByName(
        docs.join(repeated, docs[id_col] == repeated["_dropped"], "left_semi")
    )
    others = [ref(c) for c in docs.columns if c not in (id_col, text_col)]
    others = F.to_json(F.struct(*others), EXACT_TIMES) if others else F.lit("")
    marked = rest.select(
        F.struct("*").alias("doc"),
        rest[id_col].alias("id"),
        F.when(rest[id_col].isNotNull(), F.sha2(others, 256)).alias("others"),
        F.xxhash64(rest[text_col]).alias("order"),
        _digest_of(size)(rest[text_col]).alias("digest"),
    )
    kept = (
        marked.where("digest is not null")
        .groupBy("digest", "id", "others")
        .agg(F.min_by("doc", "order").alias("doc"))
        .join(changed, "digest", "left")
        .where("c is null or id = c")
        .groupBy(F.coalesce("root", "digest"), "id", "others")
        .agg(F.min_by("doc", "digest").alias("doc"))
    )
    return single.unionByName(marked.where("digest is null").select("doc.*")).unionByName(
        kept.select("doc.*")
    )

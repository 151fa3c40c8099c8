"""Exact search of the highest inner products, block at a time.

Vectors become integers, ``floor(scale * component)``. Equal vectors are one class with the
``k + 1`` smallest ids that hold it, so a vector that a third of the rows share is scored once.
Classes are put in order by a tree of principal directions, fitted on ``SAMPLE`` classes (the
smallest digests; every class is indexed), and cut into shards of document-range blocks. A
shard is one row: its vectors (the forward index), and for each block the maximum of each
*term*, which is a dimension with a sign.

A query's bound for a block is the sum of its term weights times the term maxima. It takes
blocks in descending order of bounds and scores them through the forward index until the bounds
fall below its kth score. First each query does so in its own shard, which gives it a
threshold. A shard whose own term maxima stay below the thresholds of a group of queries is
not sent to that group; the others are. Nothing is approximate: only blocks that cannot hold a
result are skipped, and equal scores count as not below. Queries whose bounds exclude little
still score most blocks, in matrix products of bounded size.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part,
neither as query nor as candidate; a missing component at the end counts as 0, so vectors of
several lengths, also empty ones, are compared; a row with a null id is a candidate like any
other and comes after equal scores with ids; rows with one id are rows each, also as queries;
with fewer candidates than ``k`` there are fewer results; an empty table or one without queries
gives an empty table; other columns, whatever their names, are not read. Scores beyond 64 bits
raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scaled_vectors import integer_rows, matrix, press, scaled
from .storage import written

#: Classes that the order is fitted on, and the depth of its tree.
SAMPLE, DEPTH = 8192, 7
#: Classes of a block, blocks of a shard, shards of a task, queries that go together.
BLOCK, BLOCKS, SHARDS, GROUP = 64, 128, 8, 2048
#: Shards whose maxima one row holds.
PACK = 1024

_INDEX = (
    "shard long, dims int, vectors binary, maxima binary, ids array<long>, keys array<string>,"
    " asked array<int>"
)
_HITS = "query string, key string, id long, score long"


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``."""
    most = [int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0 for x in (a, b)]
    bound = most[0] * most[1] * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    raise ValueError("inner products may be beyond 64 bits")


def terms(vectors: np.ndarray) -> np.ndarray:
    """Weights by term: dimensions with a plus, then dimensions with a minus."""
    return np.concatenate((vectors, -vectors), axis=1)


def block_maxima(vectors: np.ndarray, block: int) -> np.ndarray:
    """The maximum of each term in each block of rows."""
    return np.maximum.reduceat(terms(vectors), np.arange(0, len(vectors), block), axis=0)


def bounds(queries: np.ndarray, maxima: np.ndarray) -> np.ndarray:
    """For each query and block a score that no row of the block exceeds."""
    return _products(np.maximum(terms(queries), 0), maxima)


def _first(values: np.ndarray, k: int) -> np.ndarray:
    """Whether an element is among the first ``k`` of its run of equal values."""
    start = np.flatnonzero(np.diff(values, prepend=-1))
    return np.arange(len(values)) - np.repeat(start, np.diff(start, append=len(values))) < k


def block_search(
    queries: np.ndarray,
    thresholds: np.ndarray,
    open_: np.ndarray,
    vectors: np.ndarray,
    maxima: np.ndarray,
    order: np.ndarray,
    block: int,
    k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best rows of a shard for each query: query, row and score, and how many blocks were scored.

    ``open_`` tells queries without a threshold yet; ``order`` ranks rows of equal scores.
    Queries go through their own lists of blocks together, a doubling number at a time.
    """
    limit = bounds(queries, maxima)
    ranked = np.argsort(-limit, axis=1, kind="stable")
    thresholds, open_ = thresholds.copy(), open_.copy()
    found = [np.zeros((0, 3), np.int64)]
    scored, begin, step = 0, 0, 1
    active = np.arange(len(queries))
    while begin < len(maxima) and len(active):
        nth = ranked[active, begin : begin + step]
        keep = open_[active, None] | (limit[active[:, None], nth] >= thresholds[active, None])
        who, at = np.nonzero(keep)
        blocks, who = nth[who, at], active[who]
        by_block = np.argsort(blocks, kind="stable")
        blocks, who = blocks[by_block], who[by_block]
        cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
        scored += len(blocks)
        for i, j in zip(cuts, np.append(cuts, len(blocks))[1:], strict=True):
            own, b = who[i:j], int(blocks[i])
            rows = vectors[b * block : (b + 1) * block]
            scores = _products(queries[own], rows)
            q, r = np.nonzero(open_[own, None] | (scores >= thresholds[own, None]))
            found.append(np.stack((own[q], r + b * block, scores[q, r]), 1))
        hits = np.concatenate(found)
        hits = hits[np.lexsort((order[hits[:, 1]], -hits[:, 2], hits[:, 0]))]
        hits = hits[_first(hits[:, 0], k)]
        found = [hits]
        full = np.flatnonzero(np.bincount(hits[:, 0], minlength=len(queries)) >= k)
        last = np.searchsorted(hits[:, 0], full, side="right") - 1
        thresholds[full] = np.where(
            open_[full], hits[last, 2], np.maximum(thresholds[full], hits[last, 2])
        )
        open_[full] = False
        active = active[keep.any(axis=1)]  # bounds only fall from here on
        begin, step = begin + step, step * 2
    hits = found[0]
    return hits[:, 0], hits[:, 1], hits[:, 2], scored


def fit_order(sample: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Directions and cuts of a full binary tree: medians along principal directions."""
    dims = sample.shape[1]
    directions, cuts = np.zeros((2**depth - 1, dims)), np.zeros(2**depth - 1)
    held = {0: sample.astype(np.float64)}
    for node in range(2**depth - 1):
        rows = held.pop(node)
        if len(rows) > 1:
            centred = rows - rows.mean(axis=0)
            v = centred[np.argmax((centred**2).sum(axis=1))]
            for _ in range(12):
                v = centred.T @ (centred @ v)
                v = v / (np.linalg.norm(v) or 1.0)
            directions[node] = v
            cuts[node] = np.median(rows @ v)
        right = rows @ directions[node] >= cuts[node]
        held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return directions, cuts


class _Place:
    """Classes with their leaf of the tree and their place along its last direction."""

    def __init__(self, dims: int, directions: np.ndarray, cuts: np.ndarray):
        self.dims, self.directions, self.cuts = dims, directions, cuts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth = (len(self.cuts) + 1).bit_length() - 1
        for batch in batches:
            vectors = integer_rows(batch.column("x"), self.dims).astype(np.float64)
            node = np.zeros(len(vectors), np.int64)
            along = np.zeros(len(vectors))
            for _ in range(depth):
                along = np.einsum("ij,ij->i", vectors, self.directions[node])
                node = 2 * node + 1 + (along >= self.cuts[node])
            leaf = node - (2**depth - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf), pa.array(along)],
                names=[*batch.schema.names, "leaf", "along"],
            )


class _Shards:
    """Sorted classes as one row for each shard."""

    def __init__(self, dims: int, block: int, blocks: int):
        self.dims, self.block, self.size = dims, block, block * blocks

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, self.size - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == self.size:
                    yield self._row(shard, held)
                    held, n, shard = [], 0, shard + 1
        if held:
            yield self._row(shard, held)

    def _row(self, shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        vectors = integer_rows(rows.column("x").chunk(0), self.dims)
        asked = np.flatnonzero(rows.column("asked").to_numpy())
        columns = [
            pa.array([shard], pa.int64()),
            pa.array([self.dims], pa.int32()),
            pa.array([press(vectors)], pa.binary()),
            pa.array([press(block_maxima(vectors, self.block))], pa.binary()),
            pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
            pa.array([rows.column("key").to_pylist()], pa.list_(pa.string())),
            pa.array([asked.tolist()], pa.list_(pa.int32())),
        ]
        names = ["shard", "dims", "vectors", "maxima", "ids", "keys", "asked"]
        return pa.RecordBatch.from_arrays(columns, names=names)


class _Shard:
    """A row of the index, unpacked."""

    def __init__(self, row: dict):
        dims = row["dims"]
        self.vectors = matrix(row["vectors"], dims)
        self.maxima = matrix(row["maxima"], 2 * max(dims, 1))
        self.ids, self.keys, self.asked = row["ids"], row["keys"], row["asked"]
        empty = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        self.order = np.empty(len(ids), np.int64)
        self.order[np.lexsort((ids, empty))] = np.arange(len(ids))

    def search(self, queries, thresholds, open_, keys, block, k):
        """Rows of hits by name, with the thresholds that they give."""
        q, r, score, _ = block_search(
            queries, thresholds, open_, self.vectors, self.maxima, self.order, block, k
        )
        columns = {
            "query": [keys[i] for i in q.tolist()],
            "key": [self.keys[i] for i in r.tolist()],
            "id": [self.ids[i] for i in r.tolist()],
            "score": score.tolist(),
        }
        return q, score, columns


def _hits(columns: dict) -> dict:
    kinds = {"query": pa.string(), "key": pa.string(), "id": pa.int64(), "score": pa.int64()}
    return {name: pa.array(columns[name], kind) for name, kind in kinds.items()}


_GROUPS = {
    "home": pa.int64(),
    "dims": pa.int32(),
    "queries": pa.binary(),
    "keys": pa.list_(pa.string()),
    "thresholds": pa.list_(pa.int64()),
    "skip": pa.list_(pa.int64()),
}


class _Home:
    """Searches the queries of each shard in it; rows of hits, and a row for each group of queries."""

    def __init__(self, block: int, k: int, group: int):
        self.block, self.k, self.group = block, k, group

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if not row["asked"]:
                    continue
                shard = _Shard(row)
                queries = shard.vectors[row["asked"]]
                keys = [shard.keys[i] for i in row["asked"]]
                n = len(queries)
                q, score, columns = shard.search(
                    queries, np.zeros(n, np.int64), np.ones(n, bool), keys, self.block, self.k
                )
                yield self._row(_hits(columns), len(score))
                ends = np.searchsorted(q, np.arange(n), side="right")
                full = np.bincount(q, minlength=n) >= self.k
                at = [int(score[e - 1]) if f else None for e, f in zip(ends, full, strict=True)]
                held.append((row["shard"], row["dims"], queries, keys, at))
                if sum(len(x[3]) for x in held) >= self.group:
                    yield self._group(held)
                    held = []
        if held:
            yield self._group(held)

    def _group(self, held: list[tuple]) -> pa.RecordBatch:
        values = {
            "home": held[0][0],
            "dims": held[0][1],
            "queries": press(np.concatenate([x[2] for x in held])),
            "keys": [key for x in held for key in x[3]],
            "thresholds": [t for x in held for t in x[4]],
            # the shard in which each query has been searched
            "skip": [x[0] for x in held for _ in x[3]],
        }
        return self._row({n: pa.array([values[n]], t) for n, t in _GROUPS.items()}, 1)

    @staticmethod
    def _row(columns: dict, n: int) -> pa.RecordBatch:
        kinds = dict.fromkeys(("query", "key"), pa.string())
        kinds |= dict.fromkeys(("id", "score"), pa.int64()) | _GROUPS
        arrays = [columns.get(name, pa.nulls(n, kind)) for name, kind in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _queries(row: dict):
    queries = matrix(row["queries"], row["dims"])
    open_ = np.array([t is None for t in row["thresholds"]])
    return queries, np.array([t or 0 for t in row["thresholds"]], np.int64), open_


def _worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of queries and shards whose bounds reach a threshold."""
    for batch in batches:
        for row in batch.to_pylist():
            queries, thresholds, open_ = _queries(row)
            maxima = np.concatenate([matrix(m, 2 * max(row["dims"], 1)) for m in row["tops"]])
            reached = open_[:, None] | (bounds(queries, maxima) >= thresholds[:, None])
            reached &= np.array(row["skip"])[:, None] != np.array(row["shards"])[None, :]
            shards = [s for s, r in zip(row["shards"], reached.any(axis=0), strict=True) if r]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["home"]] * len(shards), pa.int64()), pa.array(shards, pa.int64())],
                names=["home", "shard"],
            )


class _Away:
    """Searches the queries of a group in another shard."""

    def __init__(self, block: int, k: int):
        self.block, self.k = block, k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                queries, thresholds, open_ = _queries(row)
                far = np.flatnonzero(np.array(row["skip"]) != row["shard"])
                keys = [row["query_keys"][i] for i in far.tolist()]
                _, _, columns = _Shard(row).search(
                    queries[far], thresholds[far], open_[far], keys, self.block, self.k
                )
                columns = _hits(columns)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The term maxima of whole shards."""
    for batch in batches:
        for row in batch.to_pylist():
            maxima = matrix(row["maxima"], 2 * max(row["dims"], 1)).max(axis=0, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]], pa.int64()), pa.array([press(maxima)], pa.binary())],
                names=["shard", "top"],
            )


def build_index(classes: DataFrame, n: int, dims: int, block: int, blocks: int, shards: int) -> DataFrame:
    """The written shards of ``classes(key, x, id, asked)``, of which there are ``n``."""
    sample = classes.select("key", "x").orderBy("key").limit(SAMPLE).collect()
    known = np.zeros((len(sample), max(dims, 1)))
    for i, row in enumerate(sample):
        known[i, : len(row["x"])] = row["x"]
    placed = classes.mapInArrow(
        _Place(dims, *fit_order(known)),
        "key string, x array<long>, id long, asked boolean, leaf long, along double",
    )
    size = block * blocks
    tasks = -(-n // (size * shards))
    tasks = max(tasks, min(-(-n // size), classes.sparkSession.sparkContext.defaultParallelism))
    dealt = placed.repartitionByRange(tasks, "leaf", "along", "key")
    ordered = dealt.sortWithinPartitions("leaf", "along", "key")
    return written(ordered.mapInArrow(_Shards(dims, block, blocks), _INDEX))


def top_products(
    rows: DataFrame,
    asked: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    block: int = BLOCK,
    blocks: int = BLOCKS,
    shards: int = SHARDS,
    group: int = GROUP,
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best other rows of each row where ``asked`` holds."""
    if not isinstance(rows.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must hold integers")
    own = {"id": rows[id_col].cast("long"), "asked": F.coalesce(asked, F.lit(False))}
    vectors = written(
        scaled(rows, vector_col, scale, **own).select(
            "id",
            "asked",
            "x",
            F.md5(F.array_join(F.col("x").cast("array<string>"), ",")).alias("key"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    # the k + 1 smallest ids that hold each vector; one of them may be the query's own
    smallest = Window.partitionBy("key").orderBy(F.col("id").asc_nulls_last(), "uid")
    holders = (
        vectors.withColumn("nth", F.row_number().over(smallest))
        .where(F.col("nth") <= k + 1)
        .groupBy("key")
        .agg(
            F.first("x").alias("x"),
            F.sort_array(F.collect_list(F.struct("nth", "id", "uid"))).alias("holders"),
        )
    )
    wanted = vectors.where("asked").select("key").distinct().withColumn("asked", F.lit(True))
    classes = written(
        holders.join(wanted, "key", "left").select(
            "key",
            "x",
            F.col("holders")[0]["id"].alias("id"),
            F.coalesce("asked", F.lit(False)).alias("asked"),
            "holders",
        )
    )
    found = classes.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    if not found["n"]:
        return vectors.limit(0).select(
            F.col("id").alias("query_id"),
            F.lit(0).alias("rank"),
            "id",
            F.col("uid").alias("score"),
        )
    index = build_index(
        classes.drop("holders"), found["n"], found["dims"], block, blocks, shards
    )

    groups = "home long, dims int, queries binary, keys array<string>, thresholds array<long>, skip array<long>"
    home = written(index.mapInArrow(_Home(block, k + 1, group), f"{_HITS}, {groups}"))
    asking = home.where("home IS NOT NULL").drop("query", "key", "id", "score")

    n_packs = -(-index.count() // PACK)
    tops = index.select("shard", "dims", "maxima").mapInArrow(_tops, "shard long, top binary")
    packs = (
        tops.withColumn("pack", F.pmod(F.xxhash64("shard"), F.lit(n_packs)))
        .groupBy("pack")
        .agg(F.collect_list(F.struct("shard", "top")).alias("all"))
        .select("pack", F.col("all.shard").alias("shards"), F.col("all.top").alias("tops"))
    )
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_packs - 1).cast("long")))
    worth = written(
        asking.withColumn("pack", each)
        .join(packs, "pack")
        .drop("pack")
        .mapInArrow(_worth, "home long, shard long")
    )
    away = (
        worth.join(asking.withColumnRenamed("keys", "query_keys").drop("dims"), "home")
        .join(index.drop("asked").withColumn("asked", F.lit(None).cast("array<int>")), "shard")
        .mapInArrow(_Away(block, k + 1), _HITS)
    )

    hits = home.where("query IS NOT NULL").select("query", "key", "id", "score").unionByName(away)
    best = Window.partitionBy("query").orderBy(
        F.col("score").desc(), F.col("id").asc_nulls_last(), "key"
    )
    top = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    # rows that hold the best vectors, in the order of results
    rows_of = (
        top.select("query", "key", "score")
        .join(classes.select("key", F.explode("holders").alias("h")), "key")
        .select("query", "score", F.col("h.id").alias("id"), F.col("h.uid").alias("uid"))
    )
    order = Window.partitionBy("query").orderBy(
        F.col("score").desc(), F.col("id").asc_nulls_last(), "uid"
    )
    lists = (
        rows_of.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "id", "uid", "score"))).alias("found"))
    )
    asking_rows = vectors.where("asked").select(
        F.col("id").alias("query_id"), F.col("uid").alias("own"), F.col("key").alias("query")
    )
    others = F.slice(F.filter("found", lambda f: f["uid"] != F.col("own")), 1, k)
    return (
        asking_rows.join(lists, "query")
        .select("query_id", F.posexplode(others).alias("place", "f"))
        .select(
            "query_id",
            (F.col("place") + 1).cast("int").alias("rank"),
            F.col("f.id").alias("id"),
            F.col("f.score").alias("score"),
        )
    )

"""Block-at-a-time search against scoring of all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import vector_search

SCHEMA = "vec_id int, embedding array<float>, " + ", ".join(
    f"{c} string" for c in ("id", "uid", "key", "x", "shard", "asked", "score", "rank", "query", "a.b")
).replace("a.b", "`a.b`")


def valid(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def expected(rows, k=5):
    """``query_id, rank, id, score``, ids of equal scores being interchangeable only by id."""
    held = [(i, [math.floor(256 * float(c)) for c in v]) for i, v, *_ in rows if valid(v)]
    out = []
    for n, (q, x) in enumerate(held):
        if q is None or q % 50:
            continue
        scored = [
            (-sum(a * b for a, b in zip(x, y, strict=False)), i is None, i or 0)
            for m, (i, y) in enumerate(held)
            if m != n
        ]
        for rank, (s, no_id, i) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, None if no_id else i, -s))
    return sorted(out, key=str)


def found(df, **options):
    asked = F.col("vec_id") % 50 == 0
    got = vector_search.top_products(df, asked, **options)
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.fixture(scope="module")
def awkward():
    r = np.random.default_rng(4)
    rows = []
    for i in range(400):
        v = [float(c) for c in np.float32(r.normal(0, 0.1, 6) + (i % 7) * 0.05)]
        if i % 9 == 0:
            v = [0.25, -0.5, 0.125, 0.0, 0.5, -0.25]  # one vector of many rows
        if i % 31 == 0:
            v = v[: i % 5]
        rows.append((i if i % 11 else 50 * (i % 3), v))
    rows += [
        (500, None), (550, [1.0, None]), (600, [float("nan")] * 6), (650, [float("inf"), 0.0]), (700, []),
        (None, [9.0] * 6), (None, [0.1] * 6), (750, [-9.0] * 6), (750, [-9.0] * 6), (800, [1.0] * 8), (-50, [-0.001] * 6),
    ]
    return [(*x, *[f"{n}" if n % 3 else None for _ in range(10)]) for n, x in enumerate(rows)]


@pytest.mark.parametrize(
    "options",
    [{}, {"block": 4, "blocks": 5, "shards": 2, "group": 3}, {"block": 1, "blocks": 1, "shards": 1, "group": 1}],
)
def test_awkward_vectors(spark, awkward, monkeypatch, options):
    if options.get("block") == 1:
        monkeypatch.setattr(vector_search, "PACK", 10)
        awkward = awkward[:60] + awkward[-11:]
    df = spark.createDataFrame([(*x[:2], *x[2:]) for x in awkward], SCHEMA).repartition(5)
    assert found(df, **options) == expected(awkward)


def test_empty_few_and_without_queries(spark, awkward):
    df = spark.createDataFrame(awkward[:12], SCHEMA)
    assert found(df.limit(0)) == []
    assert found(df.where("vec_id % 50 <> 0")) == []
    some = [r for r in awkward if r[0] in (750, 3)]
    assert found(spark.createDataFrame(some, SCHEMA)) == expected(some)
    alone = [r for r in awkward if r[0] == 800]
    assert found(spark.createDataFrame(alone, SCHEMA)) == []
    with pytest.raises(ValueError, match="integers"):
        vector_search.top_products(df, F.lit(True), id_col="key")


def test_blocks_below_the_threshold_are_skipped():
    """Clustered vectors: few blocks are scored, with the same result as all of them."""
    r = np.random.default_rng(1)
    centres = r.normal(0, 100, (40, 16))
    rows = np.sort(np.repeat(np.arange(40), 64))
    vectors = np.round(centres[rows] + r.normal(0, 5, (len(rows), 16))).astype(np.int64)
    queries = vectors[::50]
    maxima = vector_search.block_maxima(vectors, 64)
    n = len(queries)
    q, at, score, scored = vector_search.block_search(
        queries, np.zeros(n, np.int64), np.ones(n, bool), vectors, maxima, np.arange(len(vectors)), 64, 6
    )
    want = np.sort(queries @ vectors.T, axis=1)[:, ::-1][:, :6]
    assert (score.reshape(n, 6) == want).all()
    assert (vectors[at] * queries[q]).sum(axis=1).tolist() == score.tolist()
    assert scored < 0.25 * n * len(maxima)
    assert (vector_search.bounds(queries, maxima) >= np.maximum.reduceat(queries @ vectors.T, np.arange(0, len(vectors), 64), axis=1)).all()


def test_large_components(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, -(2.0**20)]), (2, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df) == expected(rows)
    with pytest.raises(Exception, match="beyond 64 bits"):
        found(spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>"))

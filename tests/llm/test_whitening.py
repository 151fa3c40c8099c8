"""Jacobi-Davidson and whitening against dense linear algebra."""

import math

import numpy as np
import pytest

from gaugeframe.llm import whitening
from gaugeframe.llm.workload import QUERIES

SCHEMA = "vec_id long, embedding array<float>, " + ", ".join(
    f"{c} string" for c in ("id", "x", "v", "n", "rows", "block", "component", "part")
)


def expected(rows, components=4):
    """By row: id, deviation; n, eigenvalues with vectors, trace, and the centred rows."""
    held = [(i, [math.floor(256 * float(c)) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(x) for _, x in held)
    held = [(i, x + [0] * (dims - len(x))) for i, x in held]
    fit = sorted({tuple(x) for _, x in held})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in held:
        away = [n * c - s for c, s in zip(x, sums, strict=True)]
        out.append((i, sum(a * a for a in away), np.array(away, float) / n @ vectors))
    return out, n, values, np.trace(centred.T @ centred) / n


def check(rows, got, components=4):
    want, n, values, trace = expected(rows, components)
    assert len(got) == len(want) * len(values)
    p = len(values)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    by_row = {}
    for r in got:
        assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / trace) < 1e-12
        by_row.setdefault((r["id"], int(r["deviation"])), []).append((r["component"], r["whitened"]))
        assert r["identity_error"] < 1e-12
    assert sorted(((i, d) for i, d, _ in want), key=key) == sorted(
        (k for k, v in by_row.items() for _ in range(len(v) // p)), key=key
    )
    signs = None
    for i, d, projected in sorted(want, key=lambda r: -r[1]):
        mine = dict(by_row[i, d])
        mine = np.array([mine[c] for c in range(1, p + 1)])
        theirs = projected / np.sqrt(values)
        if signs is None:
            signs = np.sign(mine * theirs)
        assert np.allclose(mine, signs * theirs, rtol=0, atol=1e-9)


@pytest.fixture(scope="module")
def awkward():
    r = np.random.default_rng(6)
    rows = [(i, [float(c) for c in np.float32(r.normal(0, 0.2, 7) * [1, 0.9, 0.8, 0.7, 2, 0.1, 0.3])]) for i in range(150)]
    rows += [(200 + i, [0.5, -0.5, 0.0, -0.0, 1.0, 0.25, 0.25]) for i in range(60)]  # one vector of many rows
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("-inf")] * 7), (304, [])]
    rows += [(305, [1.0, 2.0]), (None, [0.1] * 7), (None, None), (7, [0.3] * 7), (7, [0.3] * 7)]
    return [(*x, *[f"{n}" if n % 3 else None for _ in range(8)]) for n, x in enumerate(rows)]


@pytest.mark.parametrize("sums", [4096, 2])
def test_awkward_vectors(spark, awkward, monkeypatch, sums):
    monkeypatch.setattr(whitening, "SUMS", sums)
    df = spark.createDataFrame(awkward, SCHEMA).repartition(6)
    check(awkward, whitening.whiten(df).collect())


def test_query_on_whole_table(spark):
    small = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = QUERIES["op12_jacobi_davidson"](spark, small).withColumnRenamed("vec_id", "id")
    assert dict(got.dtypes)["deviation"] == "bigint"
    check([tuple(r) for r in rows], got.collect())


def test_no_variance_few_dimensions_and_empty(spark, awkward):
    df = spark.createDataFrame([(1, [0.5, 0.5, 0.1]), (2, [0.5, 0.5, 0.1])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 6 and {r["n"] for r in got} == {1}
    assert all(r["whitened"] is None and r["identity_error"] is None and r["explained"] == 0 for r in got)
    line = spark.createDataFrame([(i, [0.5 * i, 0.0, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert max(r["explained"] for r in got) == pytest.approx(1)
    assert whitening.whiten(spark.createDataFrame(awkward, SCHEMA).limit(0)).collect() == []
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert whitening.whiten(none).collect() == []
    blank = spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")
    assert [r["whitened"] for r in whitening.whiten(blank).collect()] == [None]


def test_large_entries_are_exact(spark):
    rows = [(i, [float(i * 2**38), 1.0, float(-i)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1)
    want, *_ = expected(rows, 1)
    assert sorted((r["id"], int(r["deviation"])) for r in got.collect()) == sorted((i, d) for i, d, _ in want)


@pytest.mark.parametrize(("dims", "close"), [(64, False), (64, True), (300, True), (20, False)])
def test_pairs_of_close_eigenvalues(dims, close):
    """Clustered spectra, as of vectors without much structure."""
    r = np.random.default_rng(dims)
    basis, _ = np.linalg.qr(r.normal(size=(dims, dims)))
    values = np.linspace(1, 1.9, dims) if not close else 1 + r.random(dims) * 0.05
    values[-1] = 2.5
    full = (basis * values) @ basis.T
    passes = []

    def product(u):
        passes.append(u.shape[1])
        return full @ u

    start, _ = np.linalg.qr(basis[:, ::-1][:, :16] + r.normal(size=(dims, 16)) * 0.02)
    tolerance = whitening.PRECISION * values.sum()
    got, vectors = whitening.leading_pairs(product, start, 4, tolerance)
    assert np.allclose(got, np.sort(values)[::-1][:4], rtol=1e-12)
    assert (np.linalg.norm(full @ vectors - vectors * got, axis=0) <= 2 * tolerance).all()
    assert len(passes) < 300


def test_minres_solves_indefinite_systems():
    r = np.random.default_rng(3)
    a = r.normal(size=(30, 30))
    a = a + a.T
    b = r.normal(size=(30, 3))
    shifts = np.array([0.0, 0.7, -2.0])
    x = whitening.minres(lambda v: a @ v - v * shifts, b, 60, 1e-13)
    for k in range(3):
        assert np.allclose((a - shifts[k] * np.eye(30)) @ x[:, k], b[:, k], atol=1e-8)

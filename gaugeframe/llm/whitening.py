"""Whitening of vectors on their leading components, found by Jacobi-Davidson.

Vectors become integers, ``floor(scale * component)``; the fit list is each distinct vector
once. It is written as blocks, and the covariance ``V`` is never formed: a product ``V u`` is a
pass over the blocks that centres the vectors, multiplies and adds up, a task's sum being one
row. Sums of very many tasks are added in groups first, in the order of the tasks, so the
driver gets a bounded number of them and reruns agree.

The search space starts with the leading directions of at most ``SAMPLE`` vectors of the fit
list, which only sets where the iteration begins. Rayleigh-Ritz on the space gives Ritz pairs;
a pair whose residual is at the precision of doubles (``PRECISION`` times the trace) is locked once
all larger ones are. For the others the correction equations
``(I - W W')(V - theta I)(I - W W') t = -r``, ``W`` holding the locked vectors and the search
space, are solved by a few steps of MINRES, all of them in step so that each step is one pass
over the data, and the corrections extend the space. A space that has grown is cut back to its
best Ritz vectors. When all are locked the residuals are computed anew; if any is not as small
the iteration goes on.

Defined cases: vectors that are null or hold null, NaN or infinite entries are dropped; a missing
entry at the end counts as 0, so vectors of several lengths, also empty ones, go together; there
are as many components as dimensions, if those are fewer; components without variance (all of
them where the fit list is one vector) have ``explained`` 0 and a null ``whitened``, and take no
part in ``identity_error``, which is null if no component has variance; rows of one id, and
null ids, are rows each; an empty table gives an empty table; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scaled_vectors import integer_rows, matrix, press, scaled
from .storage import written

#: Vectors that the search starts from, and directions that it starts with and is cut back to.
SAMPLE, KEPT, LARGEST = 4096, 24, 48
#: Steps of MINRES for one correction, and the residual at which they end.
STEPS, INNER = 8, 0.1
#: Residual norms count as zero below this share of the trace.
PRECISION = 2 * np.finfo(float).eps
#: Vectors of a block, and sums that the driver adds.
BLOCK_ROWS, SUMS = 4096, 4096
ROUNDS = 100


def minres(
    apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tolerance: float
) -> np.ndarray:
    """Approximate solutions of one symmetric system for each column of ``b``.

    ``apply`` multiplies each column by the matrix of its system.
    """
    x, w, w_old, v_old = (np.zeros_like(b) for _ in range(4))
    beta = np.linalg.norm(b, axis=0)
    first = beta.copy()
    v = b / np.where(beta > 0, beta, 1)
    eta = beta.copy()
    c_old, c, s_old, s = (np.full(b.shape[1], z) for z in (1.0, 1.0, 0.0, 0.0))
    beta = np.zeros_like(eta)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        one = np.hypot(delta, after)
        two = s * alpha + c_old * c * beta
        three = s_old * beta
        live = one > 0
        safe = np.where(live, one, 1)
        c_old, c = c, np.where(live, delta / safe, 1)
        s_old, s = s, np.where(live, after / safe, 0)
        w_old, w = w, np.where(live, (v - three * w_old - two * w) / safe, 0)
        x = x + c * eta * w
        eta = -s * eta
        v_old, v = v, p / np.where(after > 0, after, 1)
        beta = after
        if (np.abs(eta) <= tolerance * first).all():
            break
    return x


def _orthonormal(new: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """The columns made orthonormal, also to the spaces; those that vanish are left out."""
    out = np.zeros((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        for _ in range(3):
            for space in (*spaces, out):
                v = v - space @ (space.T @ v)
        size = np.linalg.norm(v)
        if size > 1e-10:
            out = np.column_stack((out, v / size))
    return out


def leading_pairs(
    product: Callable[[np.ndarray], np.ndarray],
    start: np.ndarray,
    wanted: int,
    tolerance: float,
    *,
    kept: int = KEPT,
    largest: int = LARGEST,
    steps: int = STEPS,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and their unit vectors, by products with a block only."""
    dims = len(start)
    locked, locked_image = np.zeros((dims, 0)), np.zeros((dims, 0))
    space = _orthonormal(start)
    image = product(space)
    for _ in range(ROUNDS):
        values, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        missing = min(wanted - locked.shape[1], space.shape[1])
        residuals = image[:, :missing] - space[:, :missing] * values[:missing]
        small = np.linalg.norm(residuals, axis=0) <= tolerance
        done = missing if small.all() else int(np.argmin(small))
        if done:
            locked = np.column_stack((locked, space[:, :done]))
            locked_image = np.column_stack((locked_image, image[:, :done]))
            space, image = space[:, done:], image[:, done:]
            values, residuals = values[done:], residuals[:, done:]
        if locked.shape[1] == wanted:
            vectors = _orthonormal(locked)
            image_now = product(vectors)
            theta = (vectors * image_now).sum(axis=0)
            if (np.linalg.norm(image_now - vectors * theta, axis=0) <= 2 * tolerance).all():
                order = np.argsort(-theta, kind="stable")
                return theta[order], vectors[:, order]
            space = np.column_stack((vectors, space))  # rounding has built up: open again
            image = product(space)
            locked, locked_image = locked[:, :0], locked_image[:, :0]
            continue
        if space.shape[1] + residuals.shape[1] > largest:
            space, image = space[:, :kept], image[:, :kept]
        fixed = np.column_stack((locked, space))

        def outside(t: np.ndarray, fixed: np.ndarray = fixed) -> np.ndarray:
            return t - fixed @ (fixed.T @ t)

        theta = values[: residuals.shape[1]]

        def corrected(t: np.ndarray, theta: np.ndarray = theta) -> np.ndarray:
            t = outside(t)
            return outside(product(t) - t * theta)

        b = -outside(residuals)
        steps_now = min(steps, dims - fixed.shape[1])
        new = minres(corrected, b, steps_now, INNER) if steps_now > 0 else b
        new = _orthonormal(np.column_stack((outside(new), b)), locked, space)
        new = new[:, : max(1, residuals.shape[1])]
        if not new.shape[1]:  # nothing is left to add: only rounding keeps the residuals up
            new = _orthonormal(np.random.default_rng(locked.shape[1]).normal(size=(dims, 1)), locked, space)
        if new.shape[1]:
            space, image = np.column_stack((space, new)), np.column_stack((image, product(new)))
        else:
            image = product(space)
    raise RuntimeError(f"residuals stay above {tolerance} after {ROUNDS} rounds")


class _Blocks:
    """Vectors as blocks of rows."""

    def __init__(self, dims: int):
        self.dims = dims

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                rows = integer_rows(batch.column("x").slice(i, BLOCK_ROWS), self.dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(rows)], pa.int64()), pa.array([press(rows)], pa.binary())],
                    names=["rows", "block"],
                )


class _Sums:
    """``value(block)`` added over the blocks of a task; a row for each task that has blocks."""

    def __init__(self, dims: int, value: Callable[[np.ndarray], np.ndarray]):
        self.dims, self.value = dims, value

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column("block").to_pylist():
                found = self.value(matrix(block, self.dims))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()], pa.int64()),
                    pa.array([total.ravel().tolist()], pa.list_(pa.float64())),
                ],
                names=["part", "total"],
            )


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    total = np.sum(np.stack(rows["total"].to_list()), axis=0)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "total": [total.tolist()]})


class FitList:
    """The distinct vectors in blocks, with exact sums of their entries."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims = blocks, dims
        self.tasks = blocks.rdd.getNumPartitions()
        exact = blocks.mapInArrow(_Exact(dims), "n string, sums array<string>, squares array<string>")
        if self.tasks > SUMS:
            exact = exact.groupBy(F.pmod(F.xxhash64("sums"), F.lit(SUMS))).applyInPandas(
                _add_exact, "n string, sums array<string>, squares array<string>"
            )
        rows = exact.collect()
        self.n = sum(int(r["n"]) for r in rows)
        self.sums = [sum(int(r["sums"][k]) for r in rows) for k in range(dims)]
        squares = [sum(int(r["squares"][k]) for r in rows) for k in range(dims)]
        #: Exact, but for the last division.
        spread = sum(self.n * q - s * s for q, s in zip(squares, self.sums, strict=True))
        self.trace = spread / self.n / self.n if self.n else 0.0

    def centred(self, block: np.ndarray) -> np.ndarray:
        return centred(block, self.n, self.sums)

    def sum(self, value: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """``value`` of the blocks, added over the fit list."""
        found = self.blocks.mapInArrow(_Sums(self.dims, value), "part long, total array<double>")
        if self.tasks > SUMS:
            found = found.groupBy((F.col("part") % SUMS).alias("g")).applyInPandas(
                _add, "part long, total array<double>"
            )
        rows = sorted((r["part"], r["total"]) for r in found.collect())
        return np.array([math.fsum(x) for x in zip(*(t for _, t in rows), strict=True)]).reshape(shape)

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times each column."""
        n, sums = self.n, self.sums

        def value(block: np.ndarray) -> np.ndarray:
            z = centred(block, n, sums)
            return z.T @ (z @ vectors)

        return self.sum(value, vectors.shape) / n


def centred(block: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` for each row, from exact integers."""
    return np.asarray(deviations(block, n, sums), np.float64) / n


def deviations(block: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: of 64 bits or, where those do not hold it, Python's integers."""
    most = max(int(block.max(initial=0)), -int(block.min(initial=0)), 1)
    if n * most + max(map(abs, sums), default=0) >= 1 << 62:
        return n * block.astype(object) - np.array(sums, object)
    return n * block - np.array(sums, np.int64)


def _exact_sums(block: np.ndarray) -> tuple[list[int], list[int]]:
    most = max(int(block.max(initial=0)), -int(block.min(initial=0)), 1)
    if most * most * len(block) >= 1 << 62:
        block = block.astype(object)
    return block.sum(axis=0).tolist(), (block * block).sum(axis=0).tolist()


class _Exact:
    def __init__(self, dims: int):
        self.dims = dims

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * self.dims, [0] * self.dims
        for batch in batches:
            for block in batch.column("block").to_pylist():
                rows = matrix(block, self.dims)
                a, b = _exact_sums(rows)
                n += len(rows)
                sums = [x + y for x, y in zip(sums, a, strict=True)]
                squares = [x + y for x, y in zip(squares, b, strict=True)]
        values = [str(n)], [list(map(str, sums))], [list(map(str, squares))]
        names = ["n", "sums", "squares"]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=names)


def _add_exact(rows: pd.DataFrame) -> pd.DataFrame:
    def total(lists) -> list[str]:
        return [str(sum(map(int, x))) for x in zip(*lists, strict=True)]

    n = str(sum(map(int, rows["n"])))
    return pd.DataFrame({"n": [n], "sums": [total(rows["sums"])], "squares": [total(rows["squares"])]})


class _Project:
    def __init__(self, dims, n, sums, values, vectors, trace, error):
        self.dims, self.n, self.sums = dims, n, sums
        self.values, self.vectors, self.trace, self.error = values, vectors, trace, error

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(self.values)
        positive = self.values > 0
        scale = np.where(positive, 1 / np.sqrt(np.where(positive, self.values, 1)), np.nan)
        explained = self.values / self.trace if self.trace else np.zeros(p)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                away = deviations(integer_rows(part.column("x"), self.dims), self.n, self.sums)
                wide = away.astype(object) if int(abs(away).max(initial=0)) ** 2 * self.dims >= 1 << 63 else away
                squares = [Decimal(int(v)) for v in (wide * wide).sum(axis=1)]
                whitened = np.asarray(away, np.float64) @ self.vectors / self.n * scale
                m = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(np.repeat(np.arange(m), p))),
                        pa.array(np.tile(np.arange(1, p + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * p, self.n)),
                        pa.array([v for v in squares for _ in range(p)], pa.decimal128(38)),
                        pa.array(whitened.ravel(), pa.float64(), mask=np.isnan(whitened.ravel())),
                        pa.array(np.tile(explained, m)),
                        pa.array([self.error] * (m * p), pa.float64()),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )


def whiten(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 4,
    scale: int = 256,
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each usable
    vector and component. ``deviation`` is a decimal of 38 digits.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, component int, n long, deviation decimal(38,0), whitened double,"
        " explained double, identity_error double"
    )
    vectors = written(scaled(rows, vector_col, scale, id=rows[id_col]))
    dims = vectors.agg(F.max(F.size("x"))).first()[0]
    if dims is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims = max(dims, 1)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    distinct = written(vectors.select(padded.alias("x")).distinct())
    fit = FitList(written(distinct.mapInArrow(_Blocks(dims), "rows long, block binary")), dims)

    sample = np.array([r["x"] for r in distinct.limit(SAMPLE).collect()], np.float64)
    around = sample - sample.mean(axis=0)
    _, _, directions = np.linalg.svd(around, full_matrices=dims <= KEPT)
    random = np.random.default_rng(0).normal(size=(dims, KEPT))
    start = _orthonormal(np.column_stack((directions[:KEPT].T, random)))[:, : min(dims, KEPT)]
    wanted = min(components, dims)
    values, found = leading_pairs(fit.product, start, wanted, PRECISION * fit.trace)
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(wanted)])
    values = np.where(values > PRECISION * dims * fit.trace, values, 0.0)

    error = None
    if (values > 0).any():
        n, sums = fit.n, fit.sums
        unit = found[:, values > 0] / np.sqrt(values[values > 0])
        p = unit.shape[1]
        mean = fit.sum(lambda block: (centred(block, n, sums) @ unit).sum(axis=0), (p,)) / n

        def square(block: np.ndarray) -> np.ndarray:
            w = centred(block, n, sums) @ unit - mean
            return w.T @ w

        error = float(np.abs(fit.sum(square, (p, p)) / n - np.eye(p)).max())
    return vectors.mapInArrow(
        _Project(dims, fit.n, fit.sums, values, found, fit.trace, error), schema
    )

"""Pairwise association of columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import as_text, n_log_n, pearson, ref
from ..plans.checks import (
    categorical_features,
    column_list,
    dtype_of,
    is_categorical_feature,
    is_numeric_feature,
    numeric_features,
    require_columns,
)
from ..plans.rows import number


#: Columns of a block; a tile is two blocks, its sums one row of generated code.
BLOCK = 4
#: Columns up to which a task holds the products of all pairs; more are cut into tiles.
WIDE = 256


def pearson_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, diagonal: bool = False
) -> DataFrame:
    """``(kind, col_a, col_b, score)`` over pairwise-complete rows.

    NULL for constant columns and where no row has both. ``diagonal`` adds the cells a heat map
    needs. Each pair is computed once. Few columns are aggregates of one row. Up to
    ``WIDE`` columns a row is a vector and its products with itself are added up as
    one matrix in each task; more are cut into blocks, and a task adds up the products of
    each two blocks before one row of them is shuffled. The plan does not grow with the columns.
    """
    columns = column_list(columns, numeric_features(df))
    require_columns(df, columns, "numeric column")
    if len(columns) < 2 and not (columns and diagonal):
        raise ValueError("correlation needs at least two numeric columns")
    if len(columns) <= BLOCK:
        pairs = _few_pairs
    else:
        pairs = _matrix_pairs if len(columns) <= WIDE else _tiled_pairs
    found = pairs(df, columns, diagonal)
    names = F.array(*[F.lit(c) for c in columns])
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return found.select(F.explode(F.array_distinct(both)).alias("p"), "score").select(
        F.lit("pearson").alias("kind"),
        F.get(names, F.col("p.i")).alias("col_a"),
        F.get(names, F.col("p.j")).alias("col_b"),
        "score",
    )


def _few_pairs(df: DataFrame, columns: Sequence[str], diagonal: bool) -> DataFrame:
    cells = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            pearson(number(df, columns[i]), number(df, columns[j])).alias("score"),
        )
        for i in range(len(columns))
        for j in range(i + (not diagonal), len(columns))
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


@contextmanager
def _compiled_methods(spark: SparkSession) -> Iterator[None]:
    """For jobs inside: code of many columns runs in small methods.

    HotSpot never compiles a method above 8000 bytes; below that limit of its own
    Spark would write all columns into one.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def _matrix_pairs(df: DataFrame, columns: Sequence[str], diagonal: bool) -> DataFrame:
    """Sums over pairwise-complete rows are cells of one Gramian matrix.

    A row is the vector of its values (0 for a missing one), of 1 and, if the table has gaps,
    of the squares and of a 1 for each present value of a column with gaps.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    values = [number(df, c) for c in columns]
    with _compiled_methods(df.sparkSession):
        seen = df.agg(
            F.count("*").alias("rows"),
            F.array(*[F.count(v) for v in values]).alias("n"),
            # values around zero, so that no digits are lost in the sums
            F.array(*[F.avg(v) for v in values]).alias("m"),
        ).first()
        shifted = [
            F.coalesce(v - F.lit(m).cast("double"), F.lit(0.0))
            for v, m in zip(values, seen["m"], strict=True)
        ]
        gaps = [k for k, n in enumerate(seen["n"]) if n < seen["rows"]]
        one = len(columns)
        squares = range(one + 1, 2 * one + 1) if gaps else range(one)
        present = {k: 2 * one + 1 + at for at, k in enumerate(gaps)}
        parts = [*shifted, F.lit(1.0)]
        if gaps:
            parts += [v * v for v in shifted]
            parts += [values[k].isNotNull().cast("double") for k in gaps]
        sums = None
        if seen["rows"]:
            vectors = df.select(array_to_vector(F.array(*parts)).alias("x"))
            rows = MLUtils.convertVectorColumnsFromML(vectors, "x")
            sums = RowMatrix(rows, numCols=len(parts)).computeGramianMatrix().toArray()

    def cell(i: int, j: int) -> tuple:
        if sums is None:
            return (i, j, *[0.0] * 6)
        a, b = present.get(i, one), present.get(j, one)
        # without gaps the squares are on the diagonal
        xx, yy = (sums[squares[k], other if gaps else k] for k, other in ((i, b), (j, a)))
        found = (sums[a, b], sums[i, b], sums[j, a], xx, yy, sums[i, j])
        return (i, j, *[float(v) for v in found])

    cells = [
        cell(i, j) for i in range(len(columns)) for j in range(i + (not diagonal), len(columns))
    ]
    names = ("n", "x", "y", "xx", "yy", "xy")
    added = df.sparkSession.createDataFrame(
        cells, "i int, j int, " + ", ".join(f"{name} double" for name in names)
    )
    return added.select("i", "j", _score(*[F.col(name) for name in names]).alias("score"))


def _tiled_pairs(df: DataFrame, columns: Sequence[str], diagonal: bool) -> DataFrame:
    # values around zero, so that no digits are lost in the sums
    means = df.agg(F.array(*[F.avg(number(df, c)) for c in columns]).alias("m")).first()["m"]
    shifted = [
        number(df, c) - F.lit(m).cast("double") for c, m in zip(columns, means, strict=True)
    ]
    missing = F.lit(None).cast("double")
    blocks = [
        F.array(*(shifted[k : k + BLOCK] + [missing] * (k + BLOCK - len(columns))))
        for k in range(0, len(columns), BLOCK)
    ]
    last = F.lit(len(blocks) - 1)
    rows = df.select(F.array(*blocks).alias("x"))
    # a row of missing values gives every tile, also if the table is empty
    nothing = F.array(*[F.array(*[missing] * BLOCK)] * len(blocks))
    rows = rows.union(df.sparkSession.range(1, numPartitions=1).select(nothing))

    def tile(p: Column, q: Column) -> Column:
        return F.struct(
            p.alias("p"),
            q.alias("q"),
            *[F.get(F.get(F.col("x"), p), F.lit(k)).alias(f"a{k}") for k in range(BLOCK)],
            *[F.get(F.get(F.col("x"), q), F.lit(k)).alias(f"b{k}") for k in range(BLOCK)],
        )

    tiles = F.flatten(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda p: F.transform(F.sequence(p, last), lambda q: tile(p, q)),
        )
    )
    cells = [(i, j) for i in range(BLOCK) for j in range(BLOCK)]
    sums = []
    for i, j in cells:
        a, b = F.col(f"a{i}"), F.col(f"b{j}")
        x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        values = {"n": F.count(a * b), "x": F.sum(x), "y": F.sum(y)}
        values |= {"xx": F.sum(x * x), "yy": F.sum(y * y), "xy": F.sum(a * b)}
        sums += [v.alias(f"{name}_{i}_{j}") for name, v in values.items()]
    added = rows.select(F.inline(tiles)).groupBy("p", "q").agg(*sums)
    scores = F.array(
        *[
            F.struct(
                (F.col("p") * BLOCK + i).alias("i"),
                (F.col("q") * BLOCK + j).alias("j"),
                _score(*[F.col(f"{name}_{i}_{j}") for name in ("n", "x", "y", "xx", "yy", "xy")]).alias(
                    "score"
                ),
            )
            for i, j in cells
        ]
    )
    i, j = F.col("i"), F.col("j")
    return added.select(F.inline(scores)).where(
        ((i <= j) if diagonal else (i < j)) & (j < len(columns))
    )


def _score(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    def root(square: Column, total: Column) -> Column:
        spread = n * square - total * total
        # what is left of a constant by rounding is no spread
        return F.sqrt(F.when(spread > n * square * 1e-12, spread))

    return (n * xy - x * y) / (root(xx, x) * root(yy, y))


def theil_u_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, diagonal: bool = False
) -> DataFrame:
    """``(kind, col_a, col_b, score)`` with score = U(col_a | col_b).

    Missing values are a category of their own. U is 0 if ``col_a`` is constant.
    All pairs share one shuffle of value-pair counts.
    """
    columns = column_list(columns, categorical_features(df))
    require_columns(df, columns, "categorical column")
    texts = [as_text(ref(c), dtype_of(df, c)) for c in columns]
    cells = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), texts[i].alias("x"), texts[j].alias("y")
        )
        for i in range(len(columns))
        for j in range(i, len(columns))
    ]
    # n ln n summed over the joint table gives the joint entropy, over (i, i) the marginal one
    entropies = (
        df.select(F.inline(F.array(*cells)))
        .groupBy("i", "j", "x", "y")
        .agg(F.count("*").alias("n"))
        .groupBy("i", "j")
        .agg(
            (
                F.log(F.sum("n").cast("double"))
                - F.sum(n_log_n(F.col("n"))) / F.sum("n").cast("double")
            ).alias("h")
        )
        .select(
            F.explode(
                F.array_distinct(
                    F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
                )
            ).alias("p"),
            "h",
        )
        .select("p.*", "h")
    )
    # at most columns x columns rows from here on
    own = entropies.filter(F.col("i") == F.col("j"))
    h_a = own.select(F.col("i"), F.col("h").alias("h_a"))
    h_b = own.select(F.col("i").alias("j"), F.col("h").alias("h_b"))
    cells_wanted = entropies if diagonal else entropies.filter(F.col("i") != F.col("j"))
    name = F.array(*[F.lit(c) for c in columns])
    u = (F.col("h_a") + F.col("h_b") - F.col("h")) / F.col("h_a")
    return (
        cells_wanted.join(F.broadcast(h_a), "i")
        .join(F.broadcast(h_b), "j")
        .select(
            F.lit("theil_u").alias("kind"),
            name[F.col("i")].alias("col_a"),
            name[F.col("j")].alias("col_b"),
            F.when(F.col("h_a") > 1e-12, u).otherwise(F.lit(0.0)).alias("score"),
        )
    )


def correlations(df: DataFrame, columns: Sequence[str], diagonal: bool = False) -> DataFrame:
    """Both matrices for a mixed list of columns; other types are passed over."""
    require_columns(df, columns)
    numeric = [c for c in columns if is_numeric_feature(dtype_of(df, c))]
    text = [c for c in columns if is_categorical_feature(dtype_of(df, c))]
    parts = []
    if len(numeric) > 1 or (numeric and diagonal):
        parts.append(pearson_matrix(df, numeric, diagonal))
    if len(text) > 1 or (text and diagonal):
        parts.append(theil_u_matrix(df, text, diagonal))
    if not parts:
        raise ValueError("needs two numeric or two categorical columns")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

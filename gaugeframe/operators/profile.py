"""Descriptive profile of a table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checks import (
    categorical_features,
    column_list,
    number_columns,
    numeric_features,
    require_columns,
)
from ..plans.counts import distinct_counts
from ..plans.quantiles import quantiles
from ..plans.rows import number

CLASS_CANDIDATE_LIMIT = 30
GRID_POINTS = 200
GRID_MARGIN = 3.0  # bandwidths beyond the extreme values
KERNEL_REACH = 39.0  # bandwidths after which exp(-z*z/2) is zero in double precision


def feature_types(df: DataFrame) -> DataFrame:
    """``(ordinal, column, kind, records_count, features_count)``.

    Numeric (with boolean) columns first, then text columns; columns of other
    types are in neither list but count as features.
    """
    kinds = [(c, "numeric") for c in numeric_features(df)]
    kinds += [(c, "categorical") for c in categorical_features(df)]
    if not kinds:
        raise ValueError("no numeric or categorical column")
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(kind).alias("kind")
            )
            for i, (c, kind) in enumerate(kinds, start=1)
        ]
    )
    return df.agg(F.count("*").alias("records_count")).select(
        F.inline(listed),
        "records_count",
        F.lit(len(df.columns)).cast("bigint").alias("features_count"),
    )


def class_candidates(df: DataFrame, limit: int = CLASS_CANDIDATE_LIMIT) -> DataFrame:
    """``(column, n_distinct, is_class_candidate)``: columns with few enough values for a label."""
    columns = numeric_features(df) + categorical_features(df)
    require_columns(df, columns, "feature")
    return distinct_counts(df, columns).select(
        "column", "n_distinct", (F.col("n_distinct") <= limit).alias("is_class_candidate")
    )


def summary_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """``(column, count, mean, std, min, p25, p50, p75, max)`` per numeric column."""
    columns = column_list(columns, number_columns(df))
    require_columns(df, columns, "numeric column")
    found = quantiles(df, columns, [0.25, 0.5, 0.75], approx)
    rows = []
    for c in columns:
        x = number(df, c)
        p25, p50, p75 = found[c]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.lit(p25).cast("double").alias("p25"),
                F.lit(p50).cast("double").alias("p50"),
                F.lit(p75).cast("double").alias("p75"),
                F.max(x).alias("max"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def density(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bandwidth_factor: float = 0.5,
    points: int = GRID_POINTS,
) -> DataFrame:
    """Gaussian kernel density on an even grid: ``(column, point, grid_x, density)``.

    Every value adds to the grid points within reach of its kernel only; the
    rest would add exactly zero. The sums combine before the shuffle, so at
    most ``points`` rows per column leave a task. Constant columns get NULL.
    """
    columns = column_list(columns, number_columns(df))
    require_columns(df, columns, "numeric column")
    stats = df.agg(
        F.array(*[_kernel_frame(df, c, bandwidth_factor, points) for c in columns]).alias("frames")
    )
    frame = F.col("frames")[F.col("c")]
    reach = F.lit(KERNEL_REACH) * F.col("f.h")
    x = F.col("f.start") + F.col("point") * F.col("f.step")
    z = (x - F.col("v")) / F.col("f.h")

    def clip(position):
        return F.greatest(F.lit(0), F.least(F.lit(points - 1), position.cast("int")))

    sums = (
        df.select(
            F.posexplode(F.array(*[number(df, c) for c in columns])).alias("c", "v"),
            stats.scalar().alias("frames"),
        )
        .select("c", "v", frame.alias("f"))
        .filter(F.col("v").isNotNull() & (F.col("f.h") > 0))
        .select(
            "c",
            "v",
            "f",
            F.explode(
                F.sequence(
                    clip(F.floor((F.col("v") - reach - F.col("f.start")) / F.col("f.step"))),
                    clip(F.ceil((F.col("v") + reach - F.col("f.start")) / F.col("f.step"))),
                )
            ).alias("point"),
        )
        .groupBy("c", "point")
        .agg(F.sum(F.exp(F.lit(-0.5) * z * z)).alias("mass"))
    )
    grid = stats.select(F.posexplode("frames").alias("c", "f")).select(
        "c", "f", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    scale = F.col("f.n") * F.col("f.h") * F.lit(math.sqrt(2.0 * math.pi))
    return grid.join(F.broadcast(sums), ["c", "point"], "left").select(
        F.array(*[F.lit(c) for c in columns])[F.col("c")].alias("column"),
        "point",
        x.alias("grid_x"),
        F.try_divide(
            F.when(F.col("f.h") > 0, F.coalesce(F.col("mass"), F.lit(0.0))), scale
        ).alias("density"),
    )


def _kernel_frame(df: DataFrame, column: str, factor: float, points: int):
    """Bandwidth and grid of one column, as an aggregate."""
    value = number(df, column)
    n = F.count(value).cast("double")
    h = F.lit(factor) * F.pow(F.nullif(n, F.lit(0.0)), F.lit(-0.2)) * F.stddev_samp(value)
    start = F.min(value) - F.lit(GRID_MARGIN) * h
    stop = F.max(value) + F.lit(GRID_MARGIN) * h
    return F.struct(
        n.alias("n"),
        h.alias("h"),
        start.alias("start"),
        ((stop - start) / F.lit(float(points - 1))).alias("step"),
    )

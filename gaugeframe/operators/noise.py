"""Laplace noise on numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import keyed_uniform, laplace_quantile, ref
from ..plans.checks import dtype_of, is_number, require_columns, require_rows
from ..plans.rows import number
from .reidentification import box_summary

DEFAULT_EPSILON = 0.1
PREFIX = "noisy_"


def add_laplace_noise(
    df: DataFrame,
    columns: Sequence[str],
    epsilon: float = DEFAULT_EPSILON,
    sensitivity: float = 1.0,
    key: Sequence[str] | None = None,
    seed: str = "0",
) -> DataFrame:
    """All columns of the complete rows, plus ``noisy_<column>`` for each column.

    The scale is ``sensitivity / epsilon``, whatever the range of the column.
    Without ``key`` every run draws new noise: write the table once and measure what was
    written, or statistics and table are of different draws. With ``key`` the noise is a function
    of the key columns and the seed: repeatable on any partitioning, but open to
    anybody who knows the seed, so of use in tests only.
    """
    require_columns(df, columns, "numeric column")
    if not epsilon > 0:
        raise ValueError("epsilon must be greater than 0")
    if not sensitivity > 0:
        raise ValueError("sensitivity must be greater than 0")
    wrong = [c for c in columns if not is_number(dtype_of(df, c))]
    if wrong:
        raise ValueError(f"not numeric: {', '.join(wrong)}")
    rows = df.na.drop("any")
    require_rows(rows, "no complete row in the dataset")
    scale = sensitivity / epsilon
    noisy = {}
    for c in columns:
        u = keyed_uniform([ref(k) for k in key], seed, c) if key else F.rand()
        noisy[PREFIX + c] = number(df, c) + laplace_quantile(u, scale)
    return rows.withColumns(noisy)


def noise_statistics(noisy: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mean_before, var_before, mean_after, var_after)``, population variance."""
    require_columns(noisy, [*columns, *[PREFIX + c for c in columns]], "noisy column")
    stats = []
    for c in columns:
        before, after = number(noisy, c), ref(PREFIX + c)
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.avg(before).alias("mean_before"),
                F.var_pop(before).alias("var_before"),
                F.avg(after).alias("mean_after"),
                F.var_pop(after).alias("var_after"),
            )
        )
    return noisy.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def noise_box_plot(noisy: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Boxes of each column before and after the noise, without outlying points."""
    series = [name for c in columns for name in (c, PREFIX + c)]
    return box_summary(noisy, series, approx)

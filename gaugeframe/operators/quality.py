"""Completeness, duplicates and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ref, row_key
from ..plans.checks import column_list, dtype_of, number_columns, require_columns
from ..plans.rows import complete_rows, is_present
from ..plans.quantiles import quantiles

FENCE = 1.5  # interquartile ranges


def completeness_by_column(
    df: DataFrame, columns: Sequence[str] | None = None, incomplete_only: bool = True
) -> DataFrame:
    """``(column, completeness)``: share of present values; complete columns left out."""
    columns = column_list(columns, df.columns)
    require_columns(df, columns)
    shares = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(is_present(df, c).cast("double")).alias("completeness"),
        )
        for c in columns
    ]
    scores = df.agg(F.array(*shares).alias("scores")).select(F.inline("scores"))
    return scores.filter(F.col("completeness") < 1) if incomplete_only else scores


def overall_completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(overall, status)``: share of rows without any missing value."""
    columns = column_list(columns, df.columns)
    require_columns(df, columns)
    whole = is_present(df, columns[0])
    for c in columns[1:]:
        whole = whole & is_present(df, c)
    status = (
        F.when(F.col("overall") == 1, "complete")
        .when(F.col("overall") == 0, "none")
        .when(F.col("overall").isNotNull(), "partial")
    )
    return df.agg(F.avg(whole.cast("double")).alias("overall")).withColumn("status", status)


def duplicity(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(rows, duplicates, duplicity)``: share of rows equal to an earlier row.

    Missing values are equal to each other. Copies collapse before the shuffle
    and long texts cross it as digests, so neither a row that is repeated a
    billion times nor wide rows weigh on one task.
    """
    columns = column_list(columns, df.columns)
    require_columns(df, columns)
    keys = [row_key(ref(c), dtype_of(df, c)).alias(f"k{i}") for i, c in enumerate(columns)]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))])
    return (
        groups.agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        )
        .withColumn(
            "duplicity",
            F.try_divide(F.col("duplicates").cast("double"), F.col("rows").cast("double")),
        )
    )


def outlier_rates(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """``(column, q1, q3, lower, upper, outlier_rate)`` by the interquartile rule.

    Rows with a missing value in any of the numeric columns are left out first.
    """
    columns = column_list(columns, number_columns(df))
    require_columns(df, columns, "numeric column")
    names = {f"v{i}": c for i, c in enumerate(columns)}
    rows = complete_rows(df, columns).select(
        *[ref(c).cast("double").alias(v) for v, c in names.items()]
    )
    quartiles = quantiles(rows, list(names), [0.25, 0.75], approx)
    rates = []
    for v, c in names.items():
        q1, q3 = quartiles[v]
        reach = None if q1 is None else FENCE * (q3 - q1)
        lower, upper = (None, None) if q1 is None else (q1 - reach, q3 + reach)
        is_out = (F.col(v) < F.lit(lower)) | (F.col(v) > F.lit(upper))
        rates.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(q1).cast("double").alias("q1"),
                F.lit(q3).cast("double").alias("q3"),
                F.lit(lower).cast("double").alias("lower"),
                F.lit(upper).cast("double").alias("upper"),
                F.avg(is_out.cast("double")).alias("outlier_rate"),
            )
        )
    return rows.agg(F.array(*rates).alias("rates")).select(F.inline("rates"))


def outlier_score(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """``(overall)``: unweighted mean of the outlier rates."""
    return outlier_rates(df, columns, approx).agg(F.avg("outlier_rate").alias("overall"))

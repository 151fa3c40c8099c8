"""Value counts of several columns in one pass, and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_double, as_text, ref
from .checks import dtype_of, is_number


def cells(df: DataFrame, columns: Sequence[str], *carry: Column) -> DataFrame:
    """Long form ``(column, value, number, *carry)``.

    ``number`` keeps the numeric order of numeric columns, whose values are
    text in the shared long form.
    """
    entries = []
    for name in columns:
        dtype = dtype_of(df, name)
        number = as_double(ref(name)) if is_number(dtype) else F.lit(None).cast("double")
        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                as_text(ref(name), dtype).alias("value"),
                number.alias("number"),
            )
        )
    return df.select(F.inline(F.array(*entries)), *carry)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, number, n)`` over non-missing values; one shuffle for all."""
    return (
        cells(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value", "number")
        .agg(F.count("*").alias("n"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n_distinct)``: exact number of values of every column, missing ones left out.

    Copies collapse before the one shuffle that all columns share.
    """
    names = F.array(*[F.lit(c) for c in columns])
    listed = df.sparkSession.range(1, numPartitions=1).select(F.explode(names).alias("column"))
    found = (
        value_counts(df, columns).groupBy("column").agg(F.count("value").alias("n_distinct"))
    )
    # one row per column
    return listed.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct")
    )

"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_double, ref


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def number(df: DataFrame, column: str) -> Column:
    """Numeric column as double with NaN read as missing."""
    if is_floating(df.schema[column].dataType):
        return as_double(ref(column))
    return ref(column).cast("double")


def is_present(df: DataFrame, column: str) -> Column:
    """Neither NULL nor NaN."""
    present = ref(column).isNotNull()
    if is_floating(df.schema[column].dataType):
        return present & ~F.isnan(ref(column))
    return present


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in the columns (default: all).

    Unlike ``na.drop`` this filters column by column, so the reader gets the
    conditions, and plans that join on the columns still share their shuffles.
    """
    for c in columns or df.columns:
        df = df.filter(is_present(df, c))
    return df

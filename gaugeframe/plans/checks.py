"""Argument checks.

Checks on names and types run at once on the schema and raise ``ValueError``.
Checks on values are part of the plan (``with_checks``) and fail when the result
is computed, whichever part of it, under a limit and also if it has no rows; they read
the same counts as the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_list(columns: Sequence[str] | None, default: Sequence[str] = ()) -> list[str]:
    if isinstance(columns, str):
        raise ValueError("columns must be given as a list of names")
    return list(columns or default)


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "column") -> None:
    columns = column_list(columns)
    if not columns:
        raise ValueError(f"no {what} given")
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"{what} not found: {', '.join(map(str, unknown))}")
    if len(set(columns)) != len(columns):
        raise ValueError(f"{what} given twice: {', '.join(columns)}")


def require_rows(df: DataFrame, message: str) -> None:
    """Stops at the first row found; no full scan unless there is none."""
    if df.isEmpty():
        raise ValueError(message)


def passes(facts: DataFrame, *checks: tuple[Column, str]) -> Column:
    """True, or an error with the message of the first condition that holds.

    The conditions are on the one row of ``facts``; as a scalar subquery they are computed
    before any row that is filtered by them.
    """
    return facts.select(_verdict(checks).alias("passes")).scalar()


def _verdict(checks) -> Column:
    verdict = F.lit(True)
    for condition, message in reversed(checks):
        error = F.raise_error(F.lit(message)).cast("boolean")
        verdict = F.when(condition, error).otherwise(verdict)
    return verdict


def checked(row: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """The one row ``row``; reading any part of it fails if a condition on it holds."""
    return row.filter(_verdict(checks))


def with_checks(df: DataFrame, facts: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """``df``; its computation fails with the message of the first condition that holds.

    The conditions are on the one row of ``facts``. Every row of ``df`` waits for them, so a
    limit or a projection fails as well; where ``df`` has no rows at all, a
    branch that never has any asks for the same subquery.
    """
    verdict = passes(facts, *checks)
    one = df.sparkSession.range(1, numPartitions=1)
    nothing = one.filter(~verdict).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    )
    return df.filter(verdict).union(nothing)


def statuses(facts: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """``(guard, failed)``: the conditions on the one row of ``facts``, in order, none raised."""
    rows = [
        F.struct(F.lit(message).alias("guard"), F.coalesce(condition, F.lit(False)).alias("failed"))
        for condition, message in checks
    ]
    return facts.select(F.inline(F.array(*rows)))


def dtype_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_numeric_feature(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_categorical_feature(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def numeric_features(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_feature(f.dataType)]


def categorical_features(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_categorical_feature(f.dataType)]

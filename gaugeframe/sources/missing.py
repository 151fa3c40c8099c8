"""Missing-value normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import MISSING_TOKENS, as_double, ref
from ..plans.checks import require_columns


def normalize_missing(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    tokens: Sequence[str] = MISSING_TOKENS,
) -> DataFrame:
    """Text tokens that stand for missing, and NaN, become NULL."""
    columns = list(columns or df.columns)
    require_columns(df, columns)
    cleaned = {}
    for name in columns:
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.StringType):
            cleaned[name] = F.when(~ref(name).isin(list(tokens)), ref(name))
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            cleaned[name] = as_double(ref(name)).cast(dtype)
    return df.withColumns(cleaned) if cleaned else df

"""Column-level building blocks. Everything here is a built-in JVM expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text tokens a CSV reader with default settings takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

#: JSON with all digits of a time.
EXACT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# Fixed value: whole-cell marker the privacy metrics also take as missing.
UNKNOWN_MARK = "?"


def ref(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_double(column: Column) -> Column:
    """Numeric column as double with NaN read as missing."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def as_text(column: Column, dtype: T.DataType) -> Column:
    """String form of a value, so that columns of several types share one shuffle."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # -0.0 and 0.0 are one value, NaN is missing
        return F.when(~F.isnan(column), column + F.lit(0).cast(dtype)).cast("string")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(canonical(column, dtype), EXACT_TIMES)
    return column.cast("string")


def canonical(column: Column, dtype: T.DataType) -> Column:
    """The value in a form of its own: no negative zero, and maps as entries in order."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return column + F.lit(0).cast(dtype)
    if isinstance(dtype, T.StructType):
        fields = [canonical(column.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else column
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: canonical(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        entry = T.StructType(
            [T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]
        )
        return F.array_sort(
            F.transform(F.map_entries(column), lambda x: canonical(x, entry)),
            lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
        )
    return column


def row_key(column: Column, dtype: T.DataType) -> Column:
    """Narrow grouping key: equal keys if and only if the values are equal.

    Texts and bytes travel through the shuffle as a SHA-256 digest, nested values
    as they are.
    """
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return canonical(column, dtype)
    if isinstance(dtype, T.VariantType):
        return F.sha2(F.to_json(column, EXACT_TIMES), 256)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.sha2(column.cast("binary"), 256)
    return column


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete correlation as one aggregate; NULL when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def n_log_n(n: Column) -> Column:
    return n * F.log(n.cast("double"))


def guarded(value: Column, *checks: tuple[Column, str]) -> Column:
    """``value``, or a runtime error when one of the conditions holds.

    The check rides on an aggregate that is computed anyway, so it costs no scan.
    """
    out = None
    for condition, message in checks:
        error = F.raise_error(F.lit(message))
        out = F.when(condition, error) if out is None else out.when(condition, error)
    return value if out is None else out.otherwise(value)


def keyed_uniform(key: Sequence[Column], *salt: str) -> Column:
    """Number in (0, 1) that depends only on the key and the salt.

    Reproducible however rows are partitioned; meant for tests, as whoever
    knows the salt can repeat it.
    """
    text = F.concat_ws("|", *[F.lit(s) for s in salt], *[k.cast("string") for k in key])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def laplace_quantile(u: Column, scale: float) -> Column:
    """Inverse CDF of Laplace(0, scale) at u in [0, 1)."""
    centred = u - F.lit(0.5)
    tail = F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(centred), F.lit(2.0**-53))
    return -F.lit(scale) * F.signum(centred) * F.log(tail)

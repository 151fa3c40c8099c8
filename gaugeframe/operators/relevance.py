"""Cleaning steps for modelling and feature-to-target relevance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distributions import chi_square_tail
from ..functions.expressions import as_text, pearson, ref
from ..plans.checks import (
    dtype_of,
    is_categorical_feature,
    is_numeric_feature,
    require_columns,
)
from ..plans.counts import cells
from ..plans.ordering import running_total
from ..plans.rows import number
from ..plans.sizing import broadcast_if_small

MISSING_LABEL = "Missing"


def impute_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing text becomes the category ``Missing``."""
    require_columns(df, columns, "categorical column")
    return df.na.fill(MISSING_LABEL, list(columns))


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers become the column mean; the columns turn into doubles."""
    require_columns(df, columns, "numeric column")
    means = df.agg(F.array(*[F.avg(number(df, c)) for c in columns]).alias("means")).scalar()
    return df.withColumns(
        {c: F.coalesce(number(df, c), means[i]) for i, c in enumerate(columns)}
    )


def one_hot(
    df: DataFrame, columns: Sequence[str], max_categories: int | None = None
) -> DataFrame:
    """Replaces each column by 0/1 columns ``<column>_<value>``, none dropped.

    The categories become column names, so they are read to the driver; with
    ``max_categories`` more of them is an error. ``one_hot_long`` needs no such
    list and suits columns of many values.
    """
    require_columns(df, columns, "categorical column")
    out = {}
    for c in columns:
        found = df.select(ref(c).alias("v")).na.drop().distinct()
        if max_categories is not None:
            found = found.limit(max_categories + 1)
        values = sorted(row["v"] for row in found.collect())
        if max_categories is not None and len(values) > max_categories:
            raise ValueError(f"'{c}' has more than {max_categories} categories")
        for v in values:
            out[f"{c}_{v}"] = F.coalesce((ref(c) == F.lit(v)).cast("int"), F.lit(0))
    return df.withColumns(out).drop(*columns)


def one_hot_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(*keys, feature, value)``: the ones of the one-hot form, a row for each.

    ``feature`` is ``<column>_<value>``; missing values have no row. Row-wise, so
    the number of categories does not matter.
    """
    require_columns(df, keys, "key column")
    require_columns(df, columns, "categorical column")
    ones = F.array(
        *[
            F.concat(F.lit(f"{c}_"), _category(ref(c), dtype_of(df, c)))
            for c in columns
        ]
    )
    return df.select(*[ref(k) for k in keys], F.explode(F.array_compact(ones)).alias("feature")).select(
        *[ref(k) for k in keys], "feature", F.lit(1).alias("value")
    )


def _category(column: Column, dtype: T.DataType) -> Column:
    """A value as it stands in a feature name; truth values begin with a capital."""
    if isinstance(dtype, T.BooleanType):
        return F.initcap(column.cast("string"))
    return as_text(column, dtype)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(label, code)``: codes 0..K-1 in sorted label order."""
    require_columns(df, [column], "label column")
    labels = df.select(ref(column).alias("label")).na.drop().distinct().withColumn("one", F.lit(1))
    ranked = running_total(labels, "one", "place", by=[], text="label", number=None)
    return ranked.select("label", (F.col("place") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Adds the code of a text label; missing labels get no code.

    The label table is broadcast only if its measured size allows.
    """
    codes = broadcast_if_small(label_codes(df, column))
    out = out or f"{column}_code"
    return (
        df.join(codes, ref(column) == F.col("label"), "left")
        .withColumnRenamed("code", out)
        .drop("label")
    )


def feature_relevance(
    df: DataFrame,
    target: str,
    categorical: Sequence[str] = (),
    numeric: Sequence[str] = (),
) -> DataFrame:
    """``(feature, corr)``: Pearson correlation of every feature with the target.

    Numeric features are mean-imputed. A categorical feature gives one score
    per value, named ``<column>_<value>``, found from the count and the target
    mean of the value alone: no one-hot column is built. Text targets are label
    encoded, rows without a target left out, constant features score NULL.
    """
    features = [*categorical, *numeric]
    require_columns(df, features, "feature")
    require_columns(df, [target], "target")
    if target in features:
        raise ValueError(f"target '{target}' is also listed as a feature")
    numeric = [c for c in numeric if is_numeric_feature(dtype_of(df, c))]
    if not categorical and not numeric:
        raise ValueError("no feature can be scored")
    rows = df.select(*[ref(c) for c in [*categorical, *numeric, target]])
    if numeric:
        rows = impute_mean(rows, numeric)
    if is_categorical_feature(dtype_of(df, target)):
        rows = label_encode(rows, target, "__y").withColumn("__y", F.col("__y").cast("double"))
    elif is_numeric_feature(dtype_of(df, target)):
        rows = rows.withColumn("__y", number(df, target))
    else:
        raise ValueError(f"target '{target}' is neither numeric nor text")
    rows = rows.filter(F.col("__y").isNotNull())

    parts = []
    if numeric:
        scores = [
            F.struct(F.lit(c).alias("feature"), pearson(ref(c), F.col("__y")).alias("corr"))
            for c in numeric
        ]
        parts.append(rows.agg(F.array(*scores).alias("scores")).select(F.inline("scores")))
    if categorical:
        parts.append(_one_hot_scores(rows, categorical))
    scores = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return scores.orderBy("feature")


def _one_hot_scores(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every one-hot column with ``__y``, from counts and means per value."""
    total = rows.agg(
        F.struct(
            F.count("*").cast("double").alias("n"),
            F.avg("__y").alias("mean"),
            F.stddev_pop("__y").alias("std"),
        ).alias("t")
    ).scalar()
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(as_text(ref(c), dtype_of(rows, c)), F.lit(MISSING_LABEL)).alias("value"),
        )
        for c in columns
    ]
    share = F.col("n") / F.col("t.n")
    return (
        rows.select(F.inline(F.array(*entries)), "__y")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"), F.avg("__y").alias("mean"))
        .withColumn("t", total)
        .select(
            F.concat_ws("_", "column", "value").alias("feature"),
            F.try_divide(
                share * (F.col("mean") - F.col("t.mean")),
                F.sqrt(share * (F.lit(1.0) - share)) * F.col("t.std"),
            ).alias("corr"),
        )
    )


def chi_square_independence(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """``(feature, chi2, degrees, p_value, n)``: Pearson's test of each column against the target.

    Rows that miss one of the two are left out. Two values on each side get Yates' correction. All
    columns share one shuffle of value-pair counts; what is joined are the counts of values.
    A column or target of one value has no degrees of freedom and no probability.
    """
    require_columns(df, columns, "feature")
    require_columns(df, [target], "target")
    if target in columns:
        raise ValueError(f"target '{target}' is also listed as a feature")
    y = as_text(ref(target), dtype_of(df, target))
    pairs = (
        cells(df, columns, y.alias("y"))
        .where("value IS NOT NULL AND y IS NOT NULL")
        .groupBy("column", "value", "y")
        .agg(F.count("*").cast("double").alias("n"))
    )
    of_value = pairs.groupBy("column", "value").agg(F.sum("n").alias("r"))
    of_class = pairs.groupBy("column", "y").agg(F.sum("n").alias("c"))

    def margin(counts: DataFrame, size: str, prefix: str) -> DataFrame:
        return counts.groupBy("column").agg(
            F.count("*").alias(f"{prefix}_kinds"),
            F.sum(1 / F.col(size)).alias(f"{prefix}_inverse"),
            F.sum(size).alias(f"{prefix}_total"),
        )

    total = margin(of_value, "r", "r").join(F.broadcast(margin(of_class, "c", "c")), "column")
    degrees = (F.col("r_kinds") - 1) * (F.col("c_kinds") - 1)
    n, expected = F.col("r_total"), F.col("r") * F.col("c") / F.col("r_total")
    # cells without rows are in the margins: their share follows from the others
    found = (
        pairs.join(of_value, ["column", "value"])
        .join(of_class, ["column", "y"])
        .join(F.broadcast(total.select("column", "r_total")), "column")
        .groupBy("column")
        .agg(
            F.sum(F.col("n") * F.col("n") / expected).alias("squares"),
            F.max(F.abs(F.col("n") - expected)).alias("most"),
        )
        .join(F.broadcast(total), "column")
    )
    # of two by two cells all are as far from what is expected
    moved = F.col("most") - F.least(F.col("most"), F.lit(0.5))
    corrected = moved * moved * n * F.col("r_inverse") * F.col("c_inverse")
    plain = F.greatest(F.col("squares") - n, F.lit(0.0))
    scored = found.select(
        F.col("column").alias("feature"),
        F.when((F.col("r_kinds") == 2) & (F.col("c_kinds") == 2), corrected)
        .when(degrees > 0, plain)
        .otherwise(F.lit(0.0))
        .alias("chi2"),
        degrees.alias("degrees"),
        n.cast("bigint").alias("n"),
    )
    return scored.select(
        "feature", "chi2", "degrees", chi_square_tail(F.col("chi2"), F.col("degrees")).alias("p_value"), "n"
    )

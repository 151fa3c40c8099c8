"""Class distribution and imbalance degree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_double, as_text, ref
from ..plans.checks import dtype_of, is_number, require_columns, statuses, with_checks

METRICS = ("EU", "CH", "KL", "HE", "TV", "CS")
MAX_CLASSES = 50
MAX_NUMERIC_VALUES = 100
SMOOTHING = 1e-10  # fixed value


def _class_counts(df: DataFrame, column: str) -> DataFrame:
    value = ref(column)
    if is_number(dtype_of(df, column)):
        value = F.when(as_double(value).isNotNull(), value)
    return (
        df.select(value.alias("class"))
        .filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.count("*").alias("n"))
    )


def _checks(df: DataFrame, column: str, k: Column, n: Column) -> list[tuple[Column, str]]:
    checks = [
        (n.isNull() | (n == 0), f"no valid data in '{column}' after dropping missing values"),
        (n < 2, f"'{column}' needs at least two rows"),
        (k < 2, f"'{column}' has only one class"),
    ]
    if is_number(dtype_of(df, column)):
        checks.append((k > MAX_NUMERIC_VALUES, f"'{column}' has too many values for classes"))
    checks.append((k > MAX_CLASSES, f"'{column}' has more than {MAX_CLASSES} classes"))
    return checks


def imbalance_guards(df: DataFrame, column: str) -> DataFrame:
    """``(guard, failed)``: what the class metrics of this column would fail with."""
    require_columns(df, [column], "target")
    facts = _class_counts(df, column).agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return statuses(facts, *_checks(df, column, F.col("k"), F.col("n")))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """``(class, count, pct)``, most frequent first; percentages to one decimal."""
    require_columns(df, [column], "target")
    counts = _class_counts(df, column)
    totals = counts.agg(
        F.struct(F.count("*").alias("k"), F.sum("n").alias("n")).alias("t")
    ).scalar()
    share = F.col("n") / F.col("t.n").cast("double") * F.lit(100.0)
    distribution = (
        counts.withColumn("t", totals)
        .select(
            as_text(F.col("class"), dtype_of(df, column)).alias("class"),
            F.col("n").alias("count"),
            F.round(share, 1).alias("pct"),
        )
    )
    facts = counts.agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    checks = _checks(df, column, F.col("k"), F.col("n"))
    return with_checks(distribution, facts, *checks).orderBy(F.desc("count"), "class")


def imbalance_degree(
    df: DataFrame, column: str, metrics: Sequence[str] = ("EU",)
) -> DataFrame:
    """``(column, metric, k, minority_classes, imbalance_degree)``, a row per metric.

    Distance of the class shares from equal shares, relative to the distance of
    the most extreme distribution with as many minority classes, plus that
    number less one. That distribution has a closed form for every metric.
    """
    require_columns(df, [column], "target")
    if not metrics or isinstance(metrics, str):
        raise ValueError("metrics must be a list of names")
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metric {', '.join(unknown)}; known are {', '.join(METRICS)}")

    counts = _class_counts(df, column)
    totals = counts.agg(
        F.struct(F.count("*").alias("k"), F.sum("n").alias("n")).alias("t")
    ).scalar()
    p, e, k = F.col("p"), F.col("e"), F.col("t.k").cast("double")
    eps = F.lit(SMOOTHING)
    smooth_p = (p + eps) / (F.lit(1.0) + k * eps)
    terms = {
        "EU": F.sqrt(F.sum((p - e) * (p - e))),
        "CH": F.max(F.abs(p - e)),
        "KL": F.sum(smooth_p * F.log(smooth_p * k)),
        "HE": F.sqrt(F.lit(0.5) * F.sum(F.pow(F.sqrt(p) - F.sqrt(e), F.lit(2.0)))),
        "TV": F.lit(0.5) * F.sum(F.abs(p - e)),
        "CS": F.sum((p - e) * (p - e) / (e + eps)),
    }
    measured = (
        counts.withColumn("t", totals)
        .select(
            "t",
            (F.col("n") / F.col("t.n").cast("double")).alias("p"),
            (F.lit(1.0) / F.col("t.k").cast("double")).alias("e"),
        )
        .agg(
            F.count("*").alias("k"),
            F.first(F.col("t.n")).alias("n"),
            F.count_if(p < e).alias("m"),
            *[terms[metric].alias(metric) for metric in metrics],
        )
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.col(metric).alias("seen"),
                _extreme(metric, F.col("k").cast("double"), F.col("m").cast("double")).alias(
                    "extreme"
                ),
            )
            for metric in metrics
        ]
    )
    ratio = F.col("seen") / F.col("extreme") + F.col("m") - F.lit(1.0)
    degree = F.when((F.col("seen") == 0) | (F.col("extreme") == 0), F.lit(0.0)).otherwise(ratio)
    degrees = measured.select("k", "n", "m", F.inline(rows)).select(
        F.lit(column).alias("column"),
        "metric",
        "k",
        F.col("m").alias("minority_classes"),
        degree.alias("imbalance_degree"),
    )
    facts = counts.agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return with_checks(degrees, facts, *_checks(df, column, F.col("k"), F.col("n")))


def _extreme(metric: str, k: Column, m: Column) -> Column:
    """Distance from equal shares of: m zeros, k-m-1 equal shares, the rest on one class."""
    k = F.when(k > 0, k)
    e = F.lit(1.0) / k
    top = (m + 1) * e
    eps = F.lit(SMOOTHING)
    if metric == "EU":
        return e * F.sqrt(m + m * m)
    if metric == "CH":
        return m * e
    if metric == "TV":
        return m * e
    if metric == "CS":
        return (m * e * e + (m * e) * (m * e)) / (e + eps)
    if metric == "HE":
        step = F.sqrt(top) - F.sqrt(e)
        return F.sqrt(F.lit(0.5) * (m * e + step * step))
    scale = F.lit(1.0) + k * eps

    def term(share):
        smooth = (share + eps) / scale
        return smooth * F.log(smooth * k)

    return m * term(F.lit(0.0)) + (k - m - 1) * term(e) + term(top)

"""Equivalence-class privacy metrics.

A class is a combination of quasi-identifier values. Tables of class sizes are
aggregated with map-side combining, so a class of any size is one row; the
statistics are then taken over a histogram of sizes. Sizes of classes add up to
the number of rows N, so there are at most sqrt(2 N) different ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import UNKNOWN_MARK, ref
from ..plans.checks import checked, column_list, dtype_of, require_columns, statuses, with_checks
from ..plans.quantiles import exact_quantiles
from ..plans.rows import complete_rows
from ..plans.sizing import settled

NOTHING_LEFT = "no data left after dropping rows with missing values"
HISTOGRAM_DECIMALS = 2


def known_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns, rows with a missing or unknown ("?") value left out."""
    selected = []
    for c in columns:
        is_text = isinstance(dtype_of(df, c), T.StringType)
        known = F.when(ref(c) != UNKNOWN_MARK, ref(c)) if is_text else ref(c)
        selected.append(known.alias(c))
    return complete_rows(df.select(*selected))


def equivalence_classes(df: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """``(*quasi_identifiers, n)``: the size of every class."""
    return _some(_classes(df, quasi_identifiers))


def _classes(df: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """The classes, unchecked: for statistics, which check their own row."""
    require_columns(df, quasi_identifiers, "quasi-identifier")
    return (
        known_rows(df, quasi_identifiers)
        .groupBy(*[ref(q) for q in quasi_identifiers])
        .agg(F.count("*").alias("n"))
    )


def _some(classes: DataFrame) -> DataFrame:
    """The classes; computing them fails if there is none."""
    facts = classes.agg(F.count("*").alias("classes"))
    return with_checks(classes, facts, (F.col("classes") == 0, NOTHING_LEFT))


def _sensitive_rows(df: DataFrame, qis: Sequence[str], sensitive: str) -> DataFrame:
    """``(q0, q1, ..., s)``; a sensitive column may also be a quasi-identifier."""
    require_columns(df, qis, "quasi-identifier")
    require_columns(df, [sensitive], "sensitive column")
    columns = [*qis, sensitive] if sensitive not in qis else list(qis)
    keys = [ref(q).alias(f"q{i}") for i, q in enumerate(qis)] + [ref(sensitive).alias("s")]
    return known_rows(df, columns).select(*keys)


def _sensitive_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def _size_histogram(classes: DataFrame, size: str) -> DataFrame:
    return classes.groupBy(F.col(size).alias("size")).agg(F.count("*").alias("n_classes"))


def _size_statistics(histogram: DataFrame, name: str) -> DataFrame:
    size, weight = F.col("size"), F.col("n_classes")
    row = histogram.agg(
        F.min(size).alias("min"),
        F.max(size).alias("max"),
        (F.sum(size * weight) / F.sum(weight).cast("double")).alias("mean"),
        F.percentile(size, F.lit(0.5), weight).cast("bigint").alias("median"),
    )
    return _known(row).select(F.col("min").alias(name), "min", "max", "mean", "median")


def _known(row: DataFrame) -> DataFrame:
    return checked(row, (F.col("min").isNull(), NOTHING_LEFT))


def k_anonymity(df: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """``(k, min, max, mean, median)`` of class sizes; the median is truncated."""
    return _size_statistics(_size_histogram(_classes(df, quasi_identifiers), "n"), "k")


def k_anonymity_histogram(df: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """``(metric, bucket, n_classes)``: number of classes per class size."""
    classes = equivalence_classes(df, quasi_identifiers)
    return _as_histogram(_size_histogram(classes, "n"), "k_anonymity")


def _diversity(df: DataFrame, qis: Sequence[str], sensitive: str) -> DataFrame:
    counts = _sensitive_counts(_sensitive_rows(df, qis, sensitive))
    return counts.groupBy(*[f"q{i}" for i in range(len(qis))]).agg(F.count("*").alias("l"))


def l_diversity(df: DataFrame, quasi_identifiers: Sequence[str], sensitive: str) -> DataFrame:
    """``(l, min, max, mean, median)`` of distinct sensitive values per class."""
    return _size_statistics(
        _size_histogram(_diversity(df, quasi_identifiers, sensitive), "l"), "l"
    )


def l_diversity_histogram(
    df: DataFrame, quasi_identifiers: Sequence[str], sensitive: str
) -> DataFrame:
    """``(metric, bucket, n_classes)``: number of classes per diversity."""
    classes = _some(_diversity(df, quasi_identifiers, sensitive))
    return _as_histogram(_size_histogram(classes, "l"), "l_diversity")


def anonymity_guards(
    df: DataFrame, quasi_identifiers: Sequence[str], sensitive: str | None = None
) -> DataFrame:
    """``(guard, failed)``: what the metrics of these columns would fail with."""
    classes = (
        _classes(df, quasi_identifiers)
        if sensitive is None
        else _sensitive_counts(_sensitive_rows(df, quasi_identifiers, sensitive))
    )
    return statuses(classes.agg(F.count("*").alias("n")), (F.col("n") == 0, NOTHING_LEFT))


def class_distances(
    df: DataFrame, quasi_identifiers: Sequence[str], sensitive: str
) -> DataFrame:
    """``(*quasi_identifiers, n, t)``: total variation distance of every class.

    With class shares p and overall shares q the distance is the sum of p - q
    over the values where p > q, so values a class lacks need no row.
    """
    qis = column_list(quasi_identifiers)
    keys = [f"q{i}" for i in range(len(qis))]
    counts = _sensitive_counts(_sensitive_rows(df, qis, sensitive))
    per_value = counts.groupBy("s").agg(F.sum("n").alias("n_s"))
    total = per_value.agg(F.sum("n_s")).scalar().cast("double")
    shares = per_value.select("s", (F.col("n_s") / total).alias("q"))
    # joins, not windows: adaptive execution broadcasts a small side and splits a hot value
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n_class"))
    whole = counts.join(sizes, keys)
    p = F.col("n") / F.col("n_class").cast("double")
    distances = (
        whole.join(shares, "s")
        .groupBy(*keys)
        .agg(
            F.first("n_class").alias("n"),
            F.sum(F.greatest(p - F.col("q"), F.lit(0.0))).alias("t"),
        )
        .select(*[F.col(k).alias(q) for k, q in zip(keys, qis)], "n", "t")
    )
    facts = counts.agg(F.count("*").alias("classes"))
    return with_checks(distances, facts, (F.col("classes") == 0, NOTHING_LEFT))


def t_closeness(df: DataFrame, quasi_identifiers: Sequence[str], sensitive: str) -> DataFrame:
    """``(t, min, max, mean, median)`` of class distances."""
    distances = settled(class_distances(df, quasi_identifiers, sensitive).select("t"))
    median = exact_quantiles(distances, ["t"], [0.5])["t"][0]
    row = distances.agg(
        F.min("t").alias("min"), F.max("t").alias("max"), F.avg("t").alias("mean")
    )
    return _known(row).select(
        F.col("max").alias("t"),
        "min",
        "max",
        "mean",
        F.lit(median).cast("double").alias("median"),
    )


def t_closeness_histogram(
    df: DataFrame, quasi_identifiers: Sequence[str], sensitive: str
) -> DataFrame:
    """``(metric, bucket, n_classes)``: number of classes per distance, to 2 decimals."""
    rounded = class_distances(df, quasi_identifiers, sensitive).select(
        F.round("t", HISTOGRAM_DECIMALS).alias("t")
    )
    return _as_histogram(_size_histogram(rounded, "t"), "t_closeness")


def entropy_risk(df: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """``(entropy_risk, min, max, mean, median)`` of class entropies log2(size).

    The risk is the sum over classes divided by the number of rows.
    """
    sizes = _size_histogram(_classes(df, quasi_identifiers), "n")
    entropy, weight = F.log2(F.col("size").cast("double")), F.col("n_classes")
    row = sizes.agg(
        F.try_divide(
            F.sum(entropy * weight), F.sum(F.col("size") * weight).cast("double")
        ).alias("risk"),
        F.min(entropy).alias("min"),
        F.max(entropy).alias("max"),
        (F.sum(entropy * weight) / F.sum(weight).cast("double")).alias("mean"),
        F.percentile(entropy, F.lit(0.5), weight).alias("median"),
    )
    return _known(row).select(
        F.col("risk").alias("entropy_risk"),
        "min",
        "max",
        "mean",
        "median",
    )


def entropy_risk_histogram(df: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """``(metric, bucket, n_classes)``: number of classes per entropy, to 2 decimals."""
    sizes = _size_histogram(equivalence_classes(df, quasi_identifiers), "n")
    entropy: Column = F.round(F.log2(F.col("size").cast("double")), HISTOGRAM_DECIMALS)
    buckets = sizes.groupBy(entropy.alias("size")).agg(F.sum("n_classes").alias("n_classes"))
    return _as_histogram(buckets, "entropy_risk")


def _as_histogram(buckets: DataFrame, metric: str) -> DataFrame:
    return buckets.select(
        F.lit(metric).alias("metric"), F.col("size").cast("double").alias("bucket"), "n_classes"
    ).orderBy("bucket")

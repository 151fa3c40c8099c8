"""Representation, outcome rates and disparities of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ref
from ..plans.checks import dtype_of, require_columns, require_rows, statuses, with_checks
from ..plans.counts import value_counts
from ..plans.ordering import running_total
from ..plans.pairing import grid, unordered_pairs
from ..plans.rows import complete_rows


def representation_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value_a, value_b, ratio)``: share of a over share of b.

    One row per unordered pair of values, the more frequent one first and ties
    in value order. The pairs are the result; they are built on the table of
    value counts, in blocks that tasks share evenly.
    """
    require_columns(df, columns, "sensitive column")
    counts = value_counts(df, columns).select("column", "value", "n")
    a, b = F.col("a"), F.col("b")
    swap = (a["n"] < b["n"]) | ((a["n"] == b["n"]) & (a["value"] > b["value"]))
    ordered = F.when(swap, F.struct(b.alias("a"), a.alias("b"))).otherwise(F.struct("a", "b"))
    return (
        unordered_pairs(counts, by=["column"], key="value")
        .select("column", ordered.alias("p"))
        .select(
            "column",
            F.col("p.a.value").alias("value_a"),
            F.col("p.b.value").alias("value_b"),
            (F.col("p.a.n").cast("double") / F.col("p.b.n").cast("double")).alias("ratio"),
        )
    )


def representation_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n, share, cum_share)``, cumulated in value order."""
    require_columns(df, columns, "sensitive column")
    counts = value_counts(df, columns)
    totals = (
        counts.groupBy("column")
        .agg(F.sum("n").alias("n"))
        .agg(F.map_from_entries(F.collect_list(F.struct("column", "n"))))
        .scalar()
    )
    total = F.col("totals")[F.col("column")].cast("double")
    return (
        running_total(counts, "n", "upto")
        .withColumn("totals", totals)
        .select(
            "column",
            "value",
            "n",
            (F.col("n") / total).alias("share"),
            (F.col("upto") / total).alias("cum_share"),
        )
    )


def real_representation_rates(populations: DataFrame, column: str) -> DataFrame:
    """``(column, value_a, value_b, ratio)`` of known populations, both ways round.

    ``populations`` holds ``(value, population)``, one row per value.
    """
    require_columns(populations, ["value", "population"], "population column")
    known = populations.select(
        F.col("value").cast("string").alias("value"), F.col("population").cast("bigint").alias("n")
    )

    def ratio(of: str, to: str) -> Column:
        return F.struct(
            F.col(f"{of}.value").alias("value_a"),
            F.col(f"{to}.value").alias("value_b"),
            F.try_divide(F.col(f"{of}.n").cast("double"), F.col(f"{to}.n").cast("double")).alias("ratio"),
        )

    return (
        unordered_pairs(known, by=[], key="value")
        .select(F.inline(F.array(ratio("a", "b"), ratio("b", "a"))))
        .select(F.lit(column).alias("column"), "value_a", "value_b", "ratio")
    )


def compare_representation(dataset: DataFrame, real: DataFrame) -> DataFrame:
    """Dataset against real-world rates, on the pairs both have.

    ``(column, value_a, value_b, real_ratio, dataset_ratio, abs_diff, pct_real,
    pct_dataset)``; the percentages split a stacked bar.
    """
    keys = ["column", "value_a", "value_b"]
    r, d = F.col("real_ratio"), F.col("dataset_ratio")
    return (
        dataset.withColumnRenamed("ratio", "dataset_ratio")
        .join(real.withColumnRenamed("ratio", "real_ratio"), keys)
        .select(
            *keys,
            r,
            d,
            F.abs(r - d).alias("abs_diff"),
            F.try_divide(r * 100.0, r + d).alias("pct_real"),
            F.try_divide(d * 100.0, r + d).alias("pct_dataset"),
        )
    )


def _outcome_counts(df: DataFrame, target: str, sensitive: str) -> DataFrame:
    require_columns(df, [target, sensitive])
    pairs = df.select(ref(sensitive).alias("group"), ref(target).alias("class"))
    return (
        complete_rows(pairs)
        .groupBy("group", "class")
        .agg(F.count("*").alias("n"))
    )


def statistical_rates(df: DataFrame, target: str, sensitive: str) -> DataFrame:
    """``(group, class, n, rate)``: share of each class in each group.

    Every group is listed with every class, with rate 0 where unseen.
    """
    counts = _outcome_counts(df, target, sensitive)
    groups = counts.groupBy("group").agg(F.sum("n").alias("total"))
    classes = counts.select("class").distinct()
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        grid(groups, classes, "group", "class")
        .join(counts, ["group", "class"], "left")
        .select("group", "class", n.alias("n"), (n / F.col("total").cast("double")).alias("rate"))
    )


def rate_deviation(df: DataFrame, target: str, sensitive: str) -> DataFrame:
    """``(class, tsd)``: population deviation of the class rate over all groups.

    Groups without the class count with rate 0; they enter as a number of
    zeros, so the group x class grid is not built.
    """
    counts = _outcome_counts(df, target, sensitive)
    groups = counts.groupBy("group").agg(F.sum("n").alias("total"))
    n_groups = groups.agg(F.count("total")).scalar().cast("double")
    seen = F.col("seen")
    mean = seen * F.col("mean") / F.col("g")
    around_seen = seen * (F.col("var") + (F.col("mean") - mean) * (F.col("mean") - mean))
    around_zero = (F.col("g") - seen) * mean * mean
    return (
        counts.join(groups, "group")
        .withColumn("rate", F.col("n") / F.col("total").cast("double"))
        .groupBy("class")
        .agg(
            F.count("*").cast("double").alias("seen"),
            F.avg("rate").alias("mean"),
            F.var_pop("rate").alias("var"),
        )
        .withColumn("g", n_groups)
        .select("class", F.sqrt((around_seen + around_zero) / F.col("g")).alias("tsd"))
    )


def _accepted_counts(df: DataFrame, target: str, sensitive: str, accepted) -> DataFrame:
    require_columns(df, [target, sensitive])
    is_accepted = ref(target).eqNullSafe(F.lit(accepted).cast(dtype_of(df, target)))
    return (
        df.filter(ref(sensitive).isNotNull())
        .groupBy(ref(sensitive).alias("group"))
        .agg(
            F.count_if(is_accepted).alias("accepted"),
            F.count_if(~is_accepted).alias("rejected"),
        )
    )


def _disparity_guards(groups: DataFrame, target: str, sensitive: str, accepted):
    facts = groups.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    return facts, [
        (F.col("accepted").isNull(), f"no group left in '{sensitive}'"),
        (F.col("accepted") == 0, f"no accepted value '{accepted}' in '{target}'"),
        (F.col("rejected") == 0, f"no rejected value in '{target}'"),
    ]


def disparity_guards(df: DataFrame, target: str, sensitive: str, accepted) -> DataFrame:
    """``(guard, failed)``: what ``demographic_disparity`` of these arguments would fail with."""
    groups = _accepted_counts(df, target, sensitive, accepted)
    facts, checks = _disparity_guards(groups, target, sensitive, accepted)
    return statuses(facts, *checks)


def demographic_disparity(df: DataFrame, target: str, sensitive: str, accepted) -> DataFrame:
    """``(group, accepted, rejected, share_of_accepted, share_of_rejected, disparity)``.

    A missing outcome counts as rejected, a missing group is left out. A group
    is at a disadvantage if its share of the rejected exceeds its share of the
    accepted. ``accepted`` is cast to the type of the outcome column.
    """
    groups = _accepted_counts(df, target, sensitive, accepted)
    require_rows(df, "target and sensitive columns are empty")
    facts, checks = _disparity_guards(groups, target, sensitive, accepted)
    totals = facts.select(F.struct("accepted", "rejected").alias("t")).scalar()
    of_accepted = F.try_divide(F.col("accepted").cast("double"), F.col("t.accepted").cast("double"))
    of_rejected = F.try_divide(F.col("rejected").cast("double"), F.col("t.rejected").cast("double"))
    shares = groups.withColumn("t", totals).select(
        "group",
        "accepted",
        "rejected",
        of_accepted.alias("share_of_accepted"),
        of_rejected.alias("share_of_rejected"),
        (of_rejected > of_accepted).alias("disparity"),
    )
    return with_checks(shares, facts, *checks)

"""Re-identification risk by a Markov model over quasi-identifiers.

The definition compares every row with every other. As the identifier is unique
the comparisons only count rows that share a value, or a pair of neighbouring
values, so the risk of a row is a function of its quasi-identifier values: it is
computed once per combination, weighted by the rows that have it. Rounded to two
decimals there are at most 101 different risks, which bounds all statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ref
from ..plans.checks import (
    checked,
    column_list,
    dtype_of,
    is_number,
    require_columns,
    statuses,
    with_checks,
)
from ..plans.counts import cells
from ..plans.quantiles import quantiles
from ..plans.rows import complete_rows, number
from ..plans.sizing import broadcast_if_small, few_combinations, settled

DECIMALS = 2
MAX_NUMERIC_VALUES = 100
WHISKER = 1.5  # interquartile ranges
NOT_UNIQUE = "identifier is not unique for each row"
NO_DATA = "no data left after dropping rows with missing values"


def _check_names(df: DataFrame, id_column: str, qis: Sequence[str]) -> None:
    require_columns(df, [id_column], "identifier column")
    require_columns(df, qis, "quasi-identifier")


def _complete(df: DataFrame, id_column: str, qis: Sequence[str]) -> DataFrame:
    """Rows with identifier and all quasi-identifiers, the latter named q0, q1, ..."""
    names = [ref(q).alias(f"q{i}") for i, q in enumerate(qis)]
    return complete_rows(df.select(ref(id_column).alias("id"), *names))


def _id_check(df: DataFrame, id_column: str, check_id: bool) -> list[tuple[Column, str]]:
    """Condition that holds if the identifier is missing or repeated anywhere."""
    if not check_id:
        return []
    copies = df.groupBy(ref(id_column).alias("id")).agg(F.count("*").alias("n"))
    broken = copies.agg(F.count_if((F.col("n") > 1) | F.col("id").isNull()))
    return [(broken.scalar() > 0, NOT_UNIQUE)]


def attribute_risks(
    df: DataFrame, id_column: str, quasi_identifiers: Sequence[str], check_id: bool = True
) -> DataFrame:
    """``(qi, value, n, score, risk)``: single-attribute risk of every value.

    ``score`` is 1 - (n/N)(1 - 1/n), ``risk`` its rounding to two decimals.
    """
    qis = column_list(quasi_identifiers)
    _check_names(df, id_column, qis)
    rows = _complete(df, id_column, qis)
    columns = [f"q{i}" for i in range(len(qis))]
    counts = (
        cells(rows, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    totals = (
        counts.groupBy("column")
        .agg(F.sum("n").alias("total"), F.count("*").alias("k"))
        .agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("total", "k")))))
        .scalar()
    )
    n, total = F.col("n"), F.col("t.total")
    score = F.lit(1.0) - n / total.cast("double") * (F.lit(1.0) - F.lit(1.0) / n)
    facts, checks = _attribute_guards(df, id_column, qis, counts, check_id)
    labels = F.create_map(*[part for c, q in zip(columns, qis) for part in (F.lit(c), F.lit(q))])
    risks = (
        counts.withColumn("t", totals[F.col("column")])
        .select(labels[F.col("column")].alias("qi"), "value", "n", score.alias("score"))
        .withColumn("risk", F.round("score", DECIMALS))
    )
    return with_checks(risks, facts, *checks)


def _attribute_guards(
    df: DataFrame, id_column: str, qis: Sequence[str], counts: DataFrame, check_id: bool
) -> tuple[DataFrame, list[tuple[Column, str]]]:
    numeric = [f"q{i}" for i, q in enumerate(qis) if is_number(dtype_of(df, q))]
    facts = (
        counts.groupBy("column")
        .agg(F.count("*").alias("k"))
        .agg(
            F.count("*").alias("seen"),
            F.min("k").alias("least"),
            F.max(F.when(F.col("column").isin(numeric), F.col("k"))).alias("most"),
        )
    )
    return facts, _id_check(df, id_column, check_id) + [
        (F.col("seen") < len(qis), NO_DATA),
        (F.col("least") == 1, "a quasi-identifier has only one value"),
        (F.col("most") > MAX_NUMERIC_VALUES, "a numeric quasi-identifier has too many values"),
    ]


def reidentification_guards(
    df: DataFrame, id_column: str, quasi_identifiers: Sequence[str]
) -> DataFrame:
    """``(guard, failed)``: what the single-attribute risks of these columns would fail with."""
    qis = column_list(quasi_identifiers)
    _check_names(df, id_column, qis)
    columns = [f"q{i}" for i in range(len(qis))]
    counts = cells(_complete(df, id_column, qis), columns).groupBy("column", "value").agg(
        F.count("*").alias("n")
    )
    facts, checks = _attribute_guards(df, id_column, qis, counts, True)
    return statuses(facts, *checks)


def attribute_risk_statistics(
    df: DataFrame, id_column: str, quasi_identifiers: Sequence[str], check_id: bool = True
) -> DataFrame:
    """``(qi, mean, std, min, p25, p50, p75, max)`` of row risks per quasi-identifier."""
    risks = attribute_risks(df, id_column, quasi_identifiers, check_id)
    return _weighted_statistics(_by_risk(risks, "qi"), "qi")


def combination_risks(
    df: DataFrame, id_column: str, quasi_identifiers: Sequence[str], check_id: bool = True
) -> DataFrame:
    """``(*quasi_identifiers, n, score, risk)``: risk of every value combination.

    The product runs over neighbouring quasi-identifiers in the given order,
    with factors (n_ab/N)(1 - 1/n_a)(1 - 1/n_b). Counts of single values and of
    pairs are rolled up from the combinations and joined back to them; the rows
    themselves are aggregated once and never joined.
    """
    qis = column_list(quasi_identifiers)
    _check_names(df, id_column, qis)
    keys = [f"q{i}" for i in range(len(qis))]
    rows = _complete(df, id_column, qis)
    table = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    totals = table.agg(F.struct(F.sum("n").alias("total")).alias("t")).scalar()

    pairs = list(zip(keys, keys[1:])) if len(keys) > 2 else []
    shared = [[k] for k in keys] + [list(pair) for pair in pairs]
    joined = table
    for columns in shared:
        # adaptive execution broadcasts small counts and splits a value that most combinations share
        counts = table.groupBy(*columns).agg(F.sum("n").cast("double").alias(_count_of(columns)))
        joined = joined.join(counts, columns)
    joined = joined.withColumn("t", totals)
    total = F.col("t.total").cast("double")

    def unobserved(k: str) -> Column:
        return F.lit(1.0) - F.lit(1.0) / F.col(_count_of([k]))

    if len(keys) == 1:
        product = F.col(_count_of(keys)) / total * unobserved(keys[0])
    else:
        product = F.lit(1.0)
        for a, b in zip(keys, keys[1:]):
            together = F.col(_count_of([a, b]) if pairs else "n").cast("double")
            product = product * (together / total) * unobserved(a) * unobserved(b)
    checks = [*_id_check(df, id_column, check_id), (F.col("total").isNull(), NO_DATA)] + [
        (F.col(f"flat_{k}"), f"quasi-identifier '{q}' has only one value")
        for k, q in zip(keys, qis)
    ]
    facts = table.agg(
        F.sum("n").alias("total"), *[(F.min(k) == F.max(k)).alias(f"flat_{k}") for k in keys]
    )
    risks = joined.select(
        *[F.col(k).alias(q) for k, q in zip(keys, qis)],
        "n",
        (F.lit(1.0) - product).alias("score"),
    ).withColumn("risk", F.round("score", DECIMALS))
    return with_checks(risks, facts, *checks)


def _count_of(columns: Sequence[str]) -> str:
    return "n_" + "_".join(columns)


def combination_risk_statistics(
    df: DataFrame, id_column: str, quasi_identifiers: Sequence[str], check_id: bool = True
) -> DataFrame:
    """``(dataset_risk, mean, std, min, p25, p50, p75, max)`` of row risks.

    ``dataset_risk`` is the length of the risk vector relative to all ones.
    """
    risks = combination_risks(df, id_column, quasi_identifiers, check_id)
    by_risk = _by_risk(risks)
    row = checked(_weighted_statistics(by_risk), (F.col("mean").isNull(), NO_DATA))
    return row.select(
        F.col("root_mean_square").alias("dataset_risk"),
        "mean",
        "std",
        "min",
        "p25",
        "p50",
        "p75",
        "max",
    )


def dataset_risk(
    df: DataFrame, id_column: str, quasi_identifiers: Sequence[str], check_id: bool = True
) -> DataFrame:
    """``(dataset_risk)``: root mean square of the row risks."""
    return combination_risk_statistics(df, id_column, quasi_identifiers, check_id).select(
        "dataset_risk"
    )


def row_risks(
    df: DataFrame, id_column: str, quasi_identifiers: Sequence[str], check_id: bool = True
) -> DataFrame:
    """``(<id_column>, score, risk)`` for every row with complete values."""
    qis = column_list(quasi_identifiers)
    risks = combination_risks(df, id_column, qis, check_id)
    keyed = risks.select(*[ref(q).alias(f"q{i}") for i, q in enumerate(qis)], "score", "risk")
    keys = [f"q{i}" for i in range(len(qis))]
    rows = _complete(df, id_column, qis)
    (is_few,) = few_combinations(rows, [keys])
    scored = rows.join(F.broadcast(keyed) if is_few else keyed, keys).select(
        F.col("id").alias(id_column), "score", "risk"
    )
    # without rows the join is left out, and with it the checks of the combinations
    facts = rows.agg(F.count("*").alias("rows"))
    checks = _id_check(df, id_column, check_id)
    return with_checks(scored, facts, *checks, (F.col("rows") == 0, NO_DATA))


def row_attribute_risks(
    df: DataFrame, id_column: str, quasi_identifiers: Sequence[str], check_id: bool = True
) -> DataFrame:
    """``(<id_column>, qi, score, risk)``: single-attribute risk, row by row."""
    qis = column_list(quasi_identifiers)
    risks = attribute_risks(df, id_column, qis, check_id)
    rows = _complete(df, id_column, qis)
    columns = [f"q{i}" for i in range(len(qis))]
    labels = F.create_map(*[part for c, q in zip(columns, qis) for part in (F.lit(c), F.lit(q))])
    long = cells(rows, columns, F.col("id")).select(
        "id", labels[F.col("column")].alias("qi"), "value"
    )
    return long.join(
        broadcast_if_small(risks.select("qi", "value", "score", "risk")), ["qi", "value"]
    ).select(F.col("id").alias(id_column), "qi", "score", "risk")


def _by_risk(risks: DataFrame, *by: str) -> DataFrame:
    return risks.groupBy(*by, "risk").agg(F.sum("n").alias("n"))


def _weighted_statistics(by_risk: DataFrame, *by: str) -> DataFrame:
    """Statistics of rows from (risk, number of rows) pairs.

    Risks are whole hundredths, so the sums behind the variance are exact.
    """
    risk, n = F.col("risk"), F.col("n")
    hundredths = F.round(risk * F.lit(100.0)).cast("bigint")

    def exact(aggregate: Column) -> Column:
        return aggregate.cast("decimal(19,0)")

    count = F.sum("n")
    first, second = F.sum(n * hundredths), F.sum(n * hundredths * hundredths)
    total = count.cast("double")
    mean = first.cast("double") / total / F.lit(100.0)
    square = second.cast("double") / total / F.lit(10_000.0)
    scatter = exact(count) * exact(second) - exact(first) * exact(first)
    deviation = F.sqrt(scatter.cast("double")) / total / F.lit(100.0)
    quartiles = F.percentile(risk, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    out = by_risk.groupBy(*by).agg(
        mean.alias("mean"),
        deviation.alias("std"),
        F.sqrt(square).alias("root_mean_square"),
        F.min(risk).alias("min"),
        quartiles.alias("q"),
        F.max(risk).alias("max"),
    )
    columns = [
        *by,
        "mean",
        "std",
        "min",
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"),
        "max",
    ]
    return out.select(*columns, *([] if by else ["root_mean_square"]))


def risk_box_plot(
    df: DataFrame,
    id_column: str,
    quasi_identifiers: Sequence[str],
    combined: bool = False,
    check_id: bool = True,
) -> DataFrame:
    """``(series, whisker_lo, q1, median, q3, whisker_hi, n_fliers)`` of row risks.

    One box per quasi-identifier, or one for their combination.
    """
    inside = F.when(~F.col("is_flier"), F.col("risk"))
    return (
        _with_boxes(df, id_column, quasi_identifiers, combined, check_id)
        .groupBy("series", "q1", "median", "q3")
        .agg(
            F.min(inside).alias("lowest"),
            F.max(inside).alias("highest"),
            F.sum(F.when(F.col("is_flier"), F.col("n")).otherwise(F.lit(0))).alias("n_fliers"),
        )
        .select(
            "series",
            F.least("lowest", "q1").alias("whisker_lo"),
            "q1",
            "median",
            "q3",
            F.greatest("highest", "q3").alias("whisker_hi"),
            "n_fliers",
        )
    )


def risk_fliers(
    df: DataFrame,
    id_column: str,
    quasi_identifiers: Sequence[str],
    combined: bool = False,
    check_id: bool = True,
) -> DataFrame:
    """``(series, risk, n)``: the risks outside the whiskers and how many rows have them."""
    boxed = _with_boxes(df, id_column, quasi_identifiers, combined, check_id)
    return boxed.filter("is_flier").select("series", "risk", "n")


def _with_boxes(
    df: DataFrame, id_column: str, qis: Sequence[str], combined: bool, check_id: bool
) -> DataFrame:
    """Risk table, at most 101 rows per series, with the box of its series."""
    if combined:
        risks = combination_risks(df, id_column, qis, check_id)
        risks = risks.select(F.lit(",".join(qis)).alias("series"), "risk", "n")
    else:
        risks = attribute_risks(df, id_column, qis, check_id).withColumnRenamed("qi", "series")
    by_risk = settled(_by_risk(risks, "series"))
    reach = F.lit(WHISKER) * (F.col("p75") - F.col("p25"))
    boxes = _weighted_statistics(by_risk, "series").select(
        "series",
        F.col("p25").alias("q1"),
        F.col("p50").alias("median"),
        F.col("p75").alias("q3"),
        (F.col("p25") - reach).alias("low"),
        (F.col("p75") + reach).alias("high"),
    )
    # one box per series, and a series is an argument of the call
    return by_risk.join(F.broadcast(boxes), "series").withColumn(
        "is_flier", (F.col("risk") < F.col("low")) | (F.col("risk") > F.col("high"))
    )


def box_summary(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``(series, whisker_lo, q1, median, q3, whisker_hi)``: a box per numeric column.

    Whiskers end at the extreme values within 1.5 interquartile ranges.
    """
    require_columns(df, columns, "numeric column")
    found = quantiles(df, columns, [0.25, 0.5, 0.75], approx)
    boxes = []
    for c in columns:
        q1, median, q3 = found[c]
        reach = None if q1 is None else WHISKER * (q3 - q1)
        low, high = (None, None) if q1 is None else (q1 - reach, q3 + reach)
        value = number(df, c)
        inside = F.when((value >= F.lit(low)) & (value <= F.lit(high)), value)
        boxes.append(
            F.struct(
                F.lit(c).alias("series"),
                F.least(F.min(inside), F.lit(q1)).cast("double").alias("whisker_lo"),
                F.lit(q1).cast("double").alias("q1"),
                F.lit(median).cast("double").alias("median"),
                F.lit(q3).cast("double").alias("q3"),
                F.greatest(F.max(inside), F.lit(q3)).cast("double").alias("whisker_hi"),
            )
        )
    return df.agg(F.array(*boxes).alias("boxes")).select(F.inline("boxes"))

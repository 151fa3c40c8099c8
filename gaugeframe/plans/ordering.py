"""Running totals over value tables without one task per total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizing import settled


def running_total(
    values: DataFrame,
    weight: str,
    out: str,
    by: Sequence[str] = ("column",),
    text: str = "value",
    number: str | None = "number",
) -> DataFrame:
    """Adds ``out`` = inclusive running sum of ``weight`` in value order, per ``by``.

    The table is dealt to ranges of the order, cut where a sample of it says so, and settled
    with the number of the range. Sums run inside ranges; the totals of the ranges, a few
    numbers whatever the values, are summed in order and added.
    """
    by = list(by)
    order = [F.col(text)] if number is None else [F.col(number), F.col(text)]
    dealt = values.repartitionByRange(*[F.col(b) for b in by], *order)
    ranged = settled(dealt.withColumn("__range", F.spark_partition_id()))
    part = [*by, "__range"]
    totals = ranged.groupBy(*part).agg(F.sum(weight).alias("__total"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy(*part).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row for each range, and one more for each value of ``by``
    return (
        ranged.withColumn("__inside", F.sum(weight).over(inside))
        .join(F.broadcast(offsets), part)
        .withColumn(out, F.col("__inside") + F.col("__offset"))
        .drop("__range", "__inside", "__offset")
    )

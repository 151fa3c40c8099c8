"""Pairs of the rows of value tables, for results that are defined on them.

Rows are dealt to slots, so many that a slot holds about ``SLOT`` rows; a pair of slots is
one key of an equi-join. The number of slots follows from the counts, so a task sees a few
pairs of slots whatever the size of the table, and every joined row is a row of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = 512


def _slots(count: Column) -> Column:
    return F.greatest(F.ceil(count / F.lit(SLOT)), F.lit(1)).cast("bigint")


def _slot(key: str, slots: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), slots)


def unordered_pairs(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """``(*by, a, b)``: each two rows of different ``key`` that agree on ``by``, once.

    ``a`` and ``b`` are structs of the other columns, in no particular order.
    """
    by = list(by)
    others = [c for c in rows.columns if c not in by]
    dealt = rows.select(*by, F.col(key).alias("key"), F.struct(*others).alias("row"))
    if by:
        (column,) = by  # its values are arguments of a call
        counts = rows.groupBy(column).agg(_slots(F.count("*")).alias("n"))
        slots = counts.agg(F.map_from_entries(F.collect_list(F.struct(column, "n")))).scalar()
        dealt = dealt.withColumn("slots", slots[F.col(column)])
    else:
        dealt = dealt.withColumn("slots", rows.agg(_slots(F.count("*"))).scalar())
    dealt = dealt.withColumn("slot", _slot("key", F.col("slots")))
    above = F.sequence("slot", F.col("slots") - 1)
    below = F.sequence(F.lit(0).cast("bigint"), "slot")
    left = dealt.select(
        *by, F.col("slot").alias("p"), F.explode(above).alias("q"), F.col("key").alias("key_a"), F.col("row").alias("a")
    )
    right = dealt.select(
        *by, F.explode(below).alias("p"), F.col("slot").alias("q"), F.col("key").alias("key_b"), F.col("row").alias("b")
    )
    # two rows of one slot meet twice there: the smaller key goes first
    once = (F.col("l.p") < F.col("l.q")) | (F.col("key_a") < F.col("key_b"))
    for c in (*by, "p", "q"):
        once = once & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return left.alias("l").join(right.alias("r"), once).select(*[F.col(f"l.{c}") for c in by], "a", "b")


def grid(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Every left row with every right row."""
    p, q = left.agg(_slots(F.count("*"))).scalar(), right.agg(_slots(F.count("*"))).scalar()
    zero = F.lit(0).cast("bigint")
    dealt_left = (
        left.withColumn("__ps", p).withColumn("__qs", q)
        .withColumn("__p", _slot(left_key, F.col("__ps")))
        .withColumn("__q", F.explode(F.sequence(zero, F.col("__qs") - 1)))
        .drop("__ps", "__qs")
    )
    dealt_right = (
        right.withColumn("__ps", p).withColumn("__qs", q)
        .withColumn("__q", _slot(right_key, F.col("__qs")))
        .withColumn("__p", F.explode(F.sequence(zero, F.col("__ps") - 1)))
        .drop("__ps", "__qs")
    )
    return dealt_left.join(dealt_right, ["__p", "__q"]).drop("__p", "__q")

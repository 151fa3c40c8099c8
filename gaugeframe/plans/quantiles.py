"""Exact quantiles of many columns without a one-task ``percentile``.

Spark's ``percentile`` gathers every distinct value of a column in the task that
merges the partial results. Here each wanted quantile is a rank that is closed
in from both sides, in three narrow passes over the columns:

1. a sketch of fixed size per column proposes a value range around each rank, and values
   that cut the range into parts of about as many rows;
2. one aggregate counts the rows below, at both ends of and inside each range.
   That proves where the rank is. If it is outside, a wider range is tried, at
   last the whole column. If it is at an end, its value is known: so a value
   that holds a third of the rows is settled here;
3. the few rows strictly inside are grouped by value and ranked, part by part. As parts are
   of equal depth, not width, long tails and infinities do not gather in one of them.

The sketch decides how fast this goes, never the result. All passes return a few
numbers per column; like ``approxQuantile`` they run at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import number

SKETCH_SIZE = 16_000
MARGINS = (0.0005, 0.01)  # ranks around the wanted one, as shares of all rows
PARTS = 64


@dataclass
class Search:
    """One wanted quantile: its two ranks and the values that should hold them.

    ``cuts`` run from the lower to the upper end of the range.
    """

    column: int
    slot: int
    position: float
    cuts: list[float]
    below: int = 0
    at_low: int = 0
    under_high: int = 0
    upto_high: int = 0
    values: dict[int, float] = field(default_factory=dict)

    @property
    def low(self) -> float:
        return self.cuts[0]

    @property
    def high(self) -> float:
        return self.cuts[-1]

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.position), math.ceil(self.position)

    @property
    def is_covered(self) -> bool:
        return self.below <= self.ranks[0] and self.ranks[1] < self.upto_high

    @property
    def inner_ranks(self) -> list[int]:
        """Ranks whose value lies strictly inside the range."""
        return [r for r in self.ranks if r not in self.values]

    def settle_ends(self) -> None:
        for r in self.ranks:
            if self.below <= r < self.below + self.at_low:
                self.values[r] = self.low
            elif self.under_high <= r < self.upto_high:
                self.values[r] = self.high

    def result(self) -> float:
        low, high = (self.values[r] for r in self.ranks)
        return low if low == high else low + (high - low) * (self.position - self.ranks[0])


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; missing values are left out."""
    columns, probabilities = list(columns), list(probabilities)
    numbers = [number(df, c) for c in columns]
    start = df.agg(
        *[_sketch(x, probabilities).alias(f"v{i}") for i, x in enumerate(numbers)]
    ).first()
    searches = [
        Search(c, slot, p * (seen["n"] - 1), _cuts(seen, slot, 0))
        for c, seen in enumerate(start)
        for slot, p in enumerate(probabilities)
        if seen["n"]
    ]
    _count(df, numbers, searches)
    for attempt in range(1, len(MARGINS) + 1):
        missed = [s for s in searches if not s.is_covered]
        for s in missed:
            s.cuts = _cuts(start[s.column], s.slot, attempt)
        _count(df, numbers, missed)
    for s in searches:
        s.settle_ends()
    _rank(df, numbers, [s for s in searches if s.inner_ranks])

    found = {(s.column, s.slot): s.result() for s in searches}
    return {
        name: [found.get((c, slot)) for slot in range(len(probabilities))]
        for c, name in enumerate(columns)
    }


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """One pass; each returned value is off by at most n / accuracy ranks."""
    sketch = df.agg(
        *[
            F.percentile_approx(number(df, c), list(probabilities), accuracy).alias(f"v{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: sketch[i] or [None] * len(probabilities) for i, c in enumerate(columns)}


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], approx: bool = False
) -> dict[str, list[float | None]]:
    find = approximate_quantiles if approx else exact_quantiles
    return find(df, columns, probabilities)


def _sketch(value: Column, probabilities: Sequence[float]) -> Column:
    """Count, extremes and, per probability and margin, the values around it; and of all parts."""
    n = F.count(value)
    sketch = F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE))
    spans = [(p - margin, p + margin) for p in probabilities for margin in MARGINS] + [(0.0, 1.0)]
    ranks = [
        F.lit(min(1.0, max(0.0, low + (high - low) * k / PARTS)))
        for low, high in spans
        for k in range(PARTS + 1)
    ]
    cuts = F.kll_sketch_get_quantile_double(sketch, F.array(*ranks))
    return F.struct(
        n.alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.when(n > 0, cuts).alias("cuts"),
    )


def _cuts(seen, slot: int, attempt: int) -> list[float]:
    """The values proposed around a rank, at a margin; at last those of the whole column."""
    width = PARTS + 1
    if attempt < len(MARGINS):
        at = width * (slot * len(MARGINS) + attempt)
        return list(seen["cuts"][at : at + width])
    return [seen["min"], *seen["cuts"][-width + 1 : -1], seen["max"]]


def _double(value: float) -> Column:
    return F.lit(value).cast("double")


def _count(df: DataFrame, numbers: Sequence[Column], searches: list[Search]) -> None:
    """Counts the rows below, at the ends of and inside every range, as one row in one pass."""
    if not searches:
        return
    counts = []
    for k, s in enumerate(searches):
        v, low, high = numbers[s.column], _double(s.low), _double(s.high)
        tests = (v < low, v == low, v < high, v <= high)
        counts += [F.count_if(t).alias(f"s{k}_{i}") for i, t in enumerate(tests)]
    row = df.agg(*counts).first()
    for k, s in enumerate(searches):
        s.below, s.at_low, s.under_high, s.upto_high = (row[f"s{k}_{i}"] for i in range(4))


def _rank(df: DataFrame, numbers: Sequence[Column], searches: list[Search]) -> None:
    """Finds the values at the inner ranks from the rows inside the ranges alone."""
    if not searches:
        return
    any_hit, hits = F.lit(False), []
    for k, s in enumerate(searches):
        v = numbers[s.column]
        is_inside = (v > _double(s.low)) & (v < _double(s.high))
        inner = sorted({c for c in s.cuts if s.low < c < s.high})
        part = F.lit(0)
        if inner:

            def below(value: Column):
                return lambda c: c < value

            part = F.size(F.filter(F.array(*[_double(c) for c in inner]), below(v)))
        hit = F.struct(F.lit(k).alias("i"), part.alias("bucket"), v.alias("v"))
        any_hit = any_hit | is_inside
        hits.append(F.when(is_inside, hit))
    counts = (
        df.filter(any_hit)
        .select(F.explode(F.array_compact(F.array(*hits))).alias("h"))
        .groupBy("h.i", "h.bucket", "h.v")
        .agg(F.count("*").alias("n"))
    )
    ends = F.create_map(
        *[
            part
            for k, s in enumerate(searches)
            for part in (F.lit(k), F.array(*[F.lit(end) for end in _inner_ends(s)]))
        ]
    )[F.col("i")]

    def running(*by: str, order: str):
        window = Window.partitionBy(*by).orderBy(order)
        return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def holds(before: Column, upto: Column) -> Column:
        return (ends[0] < upto) & (ends[1] >= before)

    # at most searches x PARTS rows, of which at most two per search stay
    upto = F.sum("total").over(running("i", order="bucket"))
    targets = (
        counts.groupBy("i", "bucket")
        .agg(F.sum("n").alias("total"))
        .withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("total"))
        .filter(holds(F.col("before"), F.col("upto")))
        .select("i", "bucket", "before")
    )
    found = (
        counts.join(F.broadcast(targets), ["i", "bucket"])
        .withColumn("upto", F.col("before") + F.sum("n").over(running("i", "bucket", order="v")))
        .withColumn("before", F.col("upto") - F.col("n"))
        .filter(holds(F.col("before"), F.col("upto")))
        .select("i", "v", "before", "upto")
        .collect()
    )
    for row in found:
        s = searches[row["i"]]
        start = s.below + s.at_low
        for r in s.inner_ranks:
            if start + row["before"] <= r < start + row["upto"]:
                s.values[r] = row["v"]


def _inner_ends(s: Search) -> tuple[int, int]:
    """First and last inner rank, counted from the first row strictly inside."""
    inner = s.inner_ranks
    return inner[0] - s.below - s.at_low, inner[-1] - s.below - s.at_low

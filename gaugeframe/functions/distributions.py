"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _with(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series ten further up."""
    z = a + F.lit(10.0)
    shift = F.lit(0.0)
    for k in range(10):
        shift = shift + F.log(a + F.lit(float(k)))
    square = z * z
    series = (1 / z) * (
        F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / square) / square) / square
    )
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - shift


def upper_gamma(a: Column, x: Column) -> Column:
    """The regularized upper incomplete gamma function Q(a, x), for a > 0 and x >= 0.

    A power series of the lower function up to x = a + 1, a continued fraction beyond.
    """
    terms = F.sequence(F.lit(1), (F.lit(100) + F.lit(12) * F.sqrt(a)).cast("int"))
    front = F.exp(a * F.log(x) - x - log_gamma(a))

    one = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    lower = front * F.aggregate(terms, one, add, lambda s: s["total"])

    def away(value: Column) -> Column:
        return F.when(F.abs(value) < _TINY, F.lit(_TINY)).otherwise(value)

    b = x + 1.0 - a
    start = F.struct(F.lit(1 / _TINY).alias("c"), (1 / away(b)).alias("d"), (1 / away(b)).alias("h"))

    def deeper(s: Column, i: Column) -> Column:
        n = i.cast("double")
        numerator = -n * (n - a)
        level = b + 2.0 * n
        d = 1 / away(numerator * s["d"] + level)
        c = away(level + numerator / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    upper = front * F.aggregate(terms, start, deeper, lambda s: s["h"])
    return (
        F.when(x <= 0, F.lit(1.0))
        .when(x < a + 1.0, F.lit(1.0) - lower)
        .otherwise(upper)
    )


def chi_square_tail(statistic: Column, degrees: Column) -> Column:
    """Probability that a chi-square variable reaches the statistic; NULL without freedom."""
    half = degrees.cast("double") / 2.0
    return F.when(
        degrees > 0,
        _with(F.struct(half.alias("a"), (statistic / 2.0).alias("x")), lambda v: upper_gamma(v["a"], v["x"])),
    )

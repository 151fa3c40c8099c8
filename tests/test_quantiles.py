"""Exact quantiles against numpy, with the passes for large data forced."""

from math import inf

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gaugeframe.plans import quantiles as q

PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 1.0]


def check(spark, columns, **kwargs):
    names = [f"c{i}" for i in range(len(columns))]
    rows = [tuple(float(x) for x in r) for r in zip(*columns)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    found = q.exact_quantiles(df, names, PROBABILITIES, **kwargs)
    for name, values in zip(names, columns):
        want = np.percentile(np.asarray(values, float), [100 * p for p in PROBABILITIES])
        assert found[name] == pytest.approx(list(want), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("sketch", [q.SKETCH_SIZE, 8])
@pytest.mark.parametrize("margins", [q.MARGINS, (0.0, 0.00001)])
def test_any_sketch_gives_the_exact_result(spark, monkeypatch, sketch, margins):
    monkeypatch.setattr(q, "SKETCH_SIZE", sketch)
    monkeypatch.setattr(q, "MARGINS", margins)
    rng = np.random.default_rng(1)
    n = 3_000
    heavy = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 1e6)
    check(
        spark,
        [rng.normal(size=n), rng.integers(0, 5, n), heavy, np.full(n, 3.5), rng.pareto(0.5, n)],
    )


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.one_of(st.integers(-5, 5), st.floats(-1e12, 1e12, allow_nan=False)),
        min_size=1,
        max_size=40,
    )
)
def test_any_values(spark, values):
    check(spark, [values])


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame(
        [(None, 1.0, 4, inf), (None, float("nan"), 2, -inf), (None, 3.0, None, inf)],
        "empty double, x double, n int, i double",
    )
    found = q.exact_quantiles(df, df.columns, [0.5])
    assert found == {"empty": [None], "x": [2.0], "n": [3.0], "i": [inf]}
    assert q.exact_quantiles(df, df.columns, [0.5]) == found


def test_approximation_is_within_its_bound(spark):
    df = spark.range(10_000).selectExpr("cast(id as double) as x")
    (low, high) = q.approximate_quantiles(df, ["x"], [0.25, 0.75], accuracy=1_000)["x"]
    assert abs(low - 2_500) <= 10 and abs(high - 7_500) <= 10

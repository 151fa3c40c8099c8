import math

import numpy as np
import pytest

import gaugeframe as gf
from gaugeframe.plans.ordering import running_total


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


GAPS = [(1, 1.0, "a"), (2, None, "b"), (3, float("nan"), None), (None, 4.0, "a")]


def test_completeness_counts_null_and_nan(spark):
    df = spark.createDataFrame(GAPS, "i int, x double, s string")
    assert rows(gf.completeness_by_column(df)) == {"i": (0.75,), "x": (0.5,), "s": (0.75,)}
    assert tuple(gf.overall_completeness(df).first()) == (0.25, "partial")
    assert rows(gf.completeness_by_column(df.select("i").na.drop())) == {}
    whole = gf.completeness_by_column(df.select("i").na.drop(), incomplete_only=False)
    assert rows(whole) == {"i": (1.0,)}


@pytest.mark.parametrize(
    "data, want",
    [([(1, 1)], (1.0, "complete")), ([(1, None), (None, 1)], (0.0, "none")), ([], (None, None))],
)
def test_completeness_status(spark, data, want):
    assert tuple(gf.overall_completeness(spark.createDataFrame(data, "a int, b int")).first()) == want


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame(
        [(1, None, float("nan")), (1, None, float("nan")), (None, "x", 0.0), (None, "x", -0.0), (2, "y", 1.0)],
        "a int, b string, c double",
    )
    assert tuple(gf.duplicity(df).first()) == (5, 2, 0.4)
    assert tuple(gf.duplicity(df.repartition(4)).first()) == (5, 2, 0.4)


def test_duplicates_of_long_and_nested_values(spark):
    long = "x" * 500
    df = spark.createDataFrame(
        [(long, [1, 2], {"a": 1, "b": 2}), (long, [1, 2], {"b": 2, "a": 1}), (long + "y", [1, 2], {"a": 1}), (None, None, None)],
        "t string, l array<int>, m map<string,int>",
    )
    assert tuple(gf.duplicity(df).first()) == (4, 1, 0.25)


def test_a_text_that_spells_a_digest_is_not_that_digest(spark):
    df = spark.sql("SELECT repeat('x', 500) AS t UNION ALL SELECT sha2(repeat('x', 500), 256)")
    assert gf.duplicity(df).first()["duplicates"] == 0


def test_duplicates_of_nothing(spark):
    assert tuple(gf.duplicity(spark.createDataFrame([], "a int")).first()) == (0, 0, None)


def test_outliers_leave_out_incomplete_rows(spark):
    data = [(float(i), 5) for i in range(1, 11)] + [(1000.0, 5), (2000.0, None), (None, 5)]
    df = spark.createDataFrame(data, "x double, c int")
    found = rows(gf.outlier_rates(df))
    x = np.array([r[0] for r in data[:11]])
    q1, q3 = np.percentile(x, [25, 75])
    assert found["x"] == (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), 1 / 11)
    assert found["c"] == (5.0, 5.0, 5.0, 5.0, 0.0)
    assert gf.outlier_score(df).first()[0] == pytest.approx(1 / 22)


def test_outliers_need_numbers(spark):
    with pytest.raises(ValueError):
        gf.outlier_rates(spark.createDataFrame([("a",)], "s string"))
    empty = rows(gf.outlier_rates(spark.createDataFrame([], "x double")))
    assert empty == {"x": (None,) * 5}


def test_summary_of_edge_columns(spark):
    df = spark.createDataFrame([(1.5, 2, None), (float("nan"), 2, None)], "a double, b int, c double")
    found = rows(gf.summary_statistics(df))
    assert found["a"] == (1, 1.5, None, 1.5, 1.5, 1.5, 1.5, 1.5)
    assert found["b"] == (2, 2.0, 0.0, 2.0, 2.0, 2.0, 2.0, 2.0)
    assert found["c"] == (0, None, None, None, None, None, None, None)


def test_feature_lists(spark):
    df = spark.createDataFrame([], "s string, n int, b boolean, t timestamp, l array<int>")
    got = [tuple(r) for r in gf.feature_types(df).orderBy("ordinal").collect()]
    assert [(r[1], r[2]) for r in got] == [("n", "numeric"), ("b", "numeric"), ("s", "categorical")]
    assert got[0][3:] == (0, 5)


def test_class_candidates_at_the_limit(spark):
    df = spark.range(10_000).selectExpr(
        "id", "id % 30 AS at_limit", "id % 31 AS above", "CAST(NULL AS STRING) AS empty"
    )
    found = rows(gf.class_candidates(df))
    assert found == {"id": (10_000, False), "at_limit": (30, True), "above": (31, False), "empty": (0, True)}


def test_density_matches_its_definition(spark):
    values = [1.0, 2.0, 2.0, 7.0, 40.0]
    df = spark.createDataFrame([(v, 1.0) for v in values], "x double, constant double")
    got = gf.density(df).collect()
    x = np.array(values)
    h = 0.5 * len(x) ** -0.2 * x.std(ddof=1)
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    for r in got:
        if r["column"] == "x":
            assert r["grid_x"] == pytest.approx(grid[r["point"]])
            assert r["density"] == pytest.approx(want[r["point"]], abs=1e-12)
        else:
            assert r["density"] is None
    assert len(got) == 400


def test_running_total_over_buckets(spark):
    numbers = [-5.0, -0.5, 0.0, 0.1, 3.0, 1e9] + [float(i) for i in range(4, 200)]
    df = spark.createDataFrame([("c", str(x), x, 2) for x in numbers], "column string, value string, number double, n int")
    got = {r["number"]: r["t"] for r in running_total(df, "n", "t").collect()}
    assert got == {x: 2 * (i + 1) for i, x in enumerate(sorted(numbers))}
    for texts in (
        ["", "a", "abcd", "abcde", "abcdf", "é", "zz", "abc"],
        [f"Customer#{i:09d}" for i in range(300)],
        ["same", "same 1", "same é", "same 10", "samé"],
    ):
        df = spark.createDataFrame([(t, 1) for t in texts], "value string, n int")
        got = {r["value"]: r["t"] for r in running_total(df, "n", "t", by=[], number=None).collect()}
        assert got == {t: i + 1 for i, t in enumerate(sorted(texts, key=lambda t: t.encode()))}
    none = spark.createDataFrame([], "value string, n int")
    assert running_total(none, "n", "t", by=[], number=None).count() == 0


def test_unknown_columns_are_named(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="missing_one"):
        gf.duplicity(df, ["a", "missing_one"])
    with pytest.raises(ValueError, match="list"):
        gf.duplicity(df, "a")


def test_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y")], "`education.num` double, `a b` string")
    assert rows(gf.summary_statistics(df))["education.num"][1] == 2.0
    assert gf.k_anonymity(df, ["education.num", "a b"]).first()["k"] == 1
    assert gf.feature_relevance(df, "education.num", categorical=["a b"]).count() == 2


def test_nested_values_are_told_apart_exactly(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        (1, named_struct('t', timestamp'2024-01-01 00:00:00.000001', 'x', array(0.0D)), map('a', 1, 'b', 2)),
        (2, named_struct('t', timestamp'2024-01-01 00:00:00.000002', 'x', array(0.0D)), map('b', 2, 'a', 1)),
        (3, named_struct('t', timestamp'2024-01-01 00:00:00.000001', 'x', array(-0.0D)), map('a', 1, 'b', 3)),
        (4, NULL, NULL) AS t(id, s, m)"""
    )
    assert gf.duplicity(df, ["s"]).first()["duplicates"] == 1
    assert gf.duplicity(df, ["m"]).first()["duplicates"] == 1
    assert gf.duplicity(df.selectExpr("array(s.t) AS a"), ["a"]).first()["duplicates"] == 1


def test_checks_fire_whatever_is_read(spark):
    none = spark.createDataFrame([(1, None, None), (2, None, "x")], "id int, a string, b string")
    twice = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q")], "id int, a string")
    for df, run in (
        (none, lambda d: gf.attribute_risks(d, "id", ["a"])),
        (none, lambda d: gf.combination_risks(d, "id", ["a", "b"])),
        (none, lambda d: gf.row_risks(d, "id", ["a", "b"])),
        (none, lambda d: gf.equivalence_classes(d, ["a"])),
        (none, lambda d: gf.class_distances(d, ["a"], "b")),
        (none, lambda d: gf.k_anonymity_histogram(d, ["a"])),
        (none, lambda d: gf.l_diversity_histogram(d, ["a"], "b")),
        (none, lambda d: gf.demographic_disparity(d, "b", "a", "x")),
        (twice, lambda d: gf.attribute_risks(d, "id", ["a"])),
        (twice, lambda d: gf.row_risks(d, "id", ["a"])),
    ):
        result = run(df)
        for read in (result.count, result.collect, result.select(result.columns[0]).collect):
            with pytest.raises(Exception, match="(?i)left|no |unique|empty"):
                read()

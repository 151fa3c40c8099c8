"""Association, relevance, imbalance and fairness against direct definitions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import gaugeframe as gf
from gaugeframe.functions.distributions import chi_square_tail
from gaugeframe.plans import pairing, sizing
from gaugeframe.plans.ordering import running_total
from gaugeframe.plans.pairing import grid, unordered_pairs


def scores(df):
    return {tuple(r)[1:3]: r["score"] for r in df.collect()}


def test_pearson_is_pairwise_complete(spark):
    data = [(1.0, 2.0, 5, True), (2.0, None, 5, False), (3.0, 1.0, 5, True), (None, 4.0, 5, False), (7.0, 9.0, 5, True)]
    df = spark.createDataFrame(data, "a double, b double, c int, d boolean")
    got = scores(gf.pearson_matrix(df, diagonal=True))
    both = [(r[0], r[1]) for r in data if r[0] is not None and r[1] is not None]
    want = np.corrcoef(np.array(both).T)[0, 1]
    assert got["a", "b"] == got["b", "a"] == pytest.approx(want)
    assert got["a", "c"] is None and got["c", "c"] is None
    assert got["a", "a"] == pytest.approx(1.0)
    assert len(got) == 16


def entropy(items):
    n = len(items)
    return -sum(c / n * math.log(c / n) for c in Counter(items).values())


def test_theil_u_matches_entropies(spark):
    rng = np.random.default_rng(3)
    data = [
        (f"x{rng.integers(4)}", None if rng.random() < 0.2 else f"y{rng.integers(3)}", "same")
        for _ in range(300)
    ]
    data += [("x0", "y0", "same")] * 100
    df = spark.createDataFrame(data, "a string, b string, c string").repartition(5)
    got = scores(gf.theil_u_matrix(df, diagonal=True))
    a, b = [r[0] for r in data], [r[1] for r in data]
    h_ab = entropy(list(zip(a, b)))
    assert got["a", "b"] == pytest.approx((entropy(a) - (h_ab - entropy(b))) / entropy(a))
    assert got["b", "a"] == pytest.approx((entropy(b) - (h_ab - entropy(a))) / entropy(b))
    assert got["a", "a"] == pytest.approx(1.0)
    assert got["c", "a"] == got["c", "c"] == 0.0
    assert got["a", "c"] == pytest.approx(0.0, abs=1e-12)


def test_correlations_need_a_pair(spark):
    df = spark.createDataFrame([(1, "a", None)], "n int, s string, t timestamp")
    with pytest.raises(ValueError):
        gf.correlations(df, ["n", "s", "t"])


def test_one_hot_and_its_limit(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, s string")
    got = {r["i"]: (r["s_a"], r["s_b"]) for r in gf.one_hot(df, ["s"]).collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (0, 1)}
    with pytest.raises(ValueError, match="more than 1"):
        gf.one_hot(df, ["s"], max_categories=1)


@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, 0])
def test_relevance_equals_one_hot_correlation(spark, monkeypatch, limit):
    monkeypatch.setattr(sizing.broadcast_if_small, "__defaults__", (limit,))
    rng = np.random.default_rng(5)
    n = 200
    x = [None if rng.random() < 0.1 else float(rng.normal()) for _ in range(n)]
    s = [None if rng.random() < 0.1 else "uvw"[rng.integers(3)] for _ in range(n)]
    y = [["lo", "mid", "hi"][rng.integers(3)] for _ in range(n)]
    df = spark.createDataFrame(list(zip(x, s, y, [1.0] * n)), "x double, s string, y string, k double")
    got = {r["feature"]: r["corr"] for r in gf.feature_relevance(df, "y", ["s"], ["x", "k"]).collect()}
    code = {label: i for i, label in enumerate(sorted(set(y)))}
    target = np.array([code[v] for v in y], float)
    mean = np.mean([v for v in x if v is not None])
    filled = np.array([mean if v is None else v for v in x])
    want = {"x": np.corrcoef(filled, target)[0, 1], "k": None}
    for value in ["Missing", "u", "v", "w"]:
        flags = np.array([(v or "Missing") == value for v in s], float)
        want[f"s_{value}"] = np.corrcoef(flags, target)[0, 1]
    assert list(got) == sorted(want)
    for feature, corr in want.items():
        assert got[feature] == (None if corr is None else pytest.approx(corr, abs=1e-12))


def test_relevance_guards(spark):
    df = spark.createDataFrame([(1, "a", None)], "n int, s string, t timestamp")
    for args in [("n", ["n"], []), ("n", [], []), ("t", ["s"], []), ("s", [], ["t"]), ("q", ["s"], [])]:
        with pytest.raises(ValueError):
            gf.feature_relevance(df, *args)


def distance(name, v, e):
    v, q = np.array(v), np.full(len(v), e)
    if name == "EU":
        return math.sqrt(((v - e) ** 2).sum())
    if name == "CH":
        return np.abs(v - e).max()
    if name == "KL":
        a, b = (v + 1e-10) / (v + 1e-10).sum(), (q + 1e-10) / (q + 1e-10).sum()
        return (a * np.log(a / b)).sum()
    if name == "HE":
        return math.sqrt(0.5 * ((np.sqrt(v) - np.sqrt(q)) ** 2).sum())
    if name == "TV":
        return 0.5 * np.abs(v - q).sum()
    return ((v - q) ** 2 / (q + 1e-10)).sum()


@pytest.mark.parametrize("counts", [[5, 1], [4, 3, 2, 1], [10, 10, 1], [6, 6, 6, 7], [1] * 49 + [30]])
def test_imbalance_degree(spark, counts):
    data = [(f"k{i}",) for i, n in enumerate(counts) for _ in range(n)] + [(None,)]
    names = ["EU", "CH", "KL", "HE", "TV", "CS"]
    got = {r["metric"]: r for r in gf.imbalance_degree(spark.createDataFrame(data, "c string"), "c", names).collect()}
    k, p = len(counts), np.array(counts) / sum(counts)
    m = int((p < 1 / k).sum())
    extreme = [0.0] * m + [1 / k] * (k - m - 1) + [1 - (k - m - 1) / k]
    for name in names:
        want = distance(name, p, 1 / k) / distance(name, extreme, 1 / k) + m - 1
        assert got[name]["imbalance_degree"] == pytest.approx(want, rel=1e-9)
        assert (got[name]["k"], got[name]["minority_classes"]) == (k, m)


def test_balanced_classes_have_degree_zero(spark):
    df = spark.createDataFrame([("a",), ("b",)] * 5, "c string")
    got = gf.imbalance_degree(df, "c", ["EU", "CH", "HE", "TV", "CS"]).collect()
    assert [r["imbalance_degree"] for r in got] == [0.0] * 5


@pytest.mark.parametrize(
    "data, message",
    [
        ([], "no valid data"),
        ([(None,)], "no valid data"),
        ([(1,)], "at least two rows"),
        ([(1,), (1,)], "only one class"),
        ([(i,) for i in range(51)], "more than 50"),
        ([(i,) for i in range(101)], "too many values"),
    ],
)
def test_class_guards(spark, data, message):
    df = spark.createDataFrame(data, "c int")
    with pytest.raises(Exception, match=message):
        gf.imbalance_degree(df, "c").collect()
    with pytest.raises(Exception, match=message):
        gf.class_distribution(df, "c").collect()
    with pytest.raises(Exception, match=message):
        gf.imbalance_degree(df, "c").select("k").collect()
    with pytest.raises(Exception, match=message):
        gf.class_distribution(df, "c").count()


def test_unknown_metric(spark):
    df = spark.createDataFrame([(1,), (2,)], "c int")
    with pytest.raises(ValueError, match="unknown metric"):
        gf.imbalance_degree(df, "c", ["XX"])


def test_class_distribution_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "c string")
    got = [tuple(r) for r in gf.class_distribution(df, "c").collect()]
    assert got == [("c", 2, 50.0), ("a", 1, 25.0), ("b", 1, 25.0)]


def test_grid_is_the_full_product(spark):
    left = spark.createDataFrame([(i,) for i in range(7)], "a int")
    right = spark.createDataFrame([(i,) for i in range(50)], "b int")
    got = {tuple(r) for r in grid(left, right, "a", "b").collect()}
    assert got == {(a, b) for a in range(7) for b in range(50)}


def test_representation_pairs_and_ties(spark):
    df = spark.createDataFrame([("b", "b"), ("a", "b"), ("c", None), ("c", "a")], "s string, t string")
    got = {tuple(r) for r in gf.representation_rates(df, ["s", "t"]).collect()}
    assert got == {("s", "c", "a", 2.0), ("s", "c", "b", 2.0), ("s", "a", "b", 1.0), ("t", "b", "a", 2.0)}
    assert gf.representation_rates(df.limit(0), ["s"]).count() == 0


def test_shares_follow_the_order_of_the_type(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (100,), (None,)], "n int")
    got = {r["value"]: (r["share"], r["cum_share"]) for r in gf.representation_shares(df, ["n"]).collect()}
    assert got == {"9": (0.25, 0.25), "10": (0.5, 0.75), "100": (0.25, 1.0)}


def test_real_rates_with_an_empty_population(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0)], "value string, population bigint")
    got = {(r["value_a"], r["value_b"]): r["ratio"] for r in gf.real_representation_rates(df, "c").collect()}
    assert got == {("a", "b"): None, ("b", "a"): 0.0}


def test_statistical_rates_list_unseen_classes(spark):
    data = [("g1", 1), ("g1", 1), ("g1", 0), ("g2", 0), (None, 1), ("g3", None)]
    df = spark.createDataFrame(data, "g string, y int")
    got = {(r["group"], r["class"]): (r["n"], r["rate"]) for r in gf.statistical_rates(df, "y", "g").collect()}
    assert got == {("g1", 1): (2, 2 / 3), ("g1", 0): (1, 1 / 3), ("g2", 0): (1, 1.0), ("g2", 1): (0, 0.0)}
    tsd = {r["class"]: r["tsd"] for r in gf.rate_deviation(df, "y", "g").collect()}
    assert tsd[1] == pytest.approx(np.std([2 / 3, 0])) and tsd[0] == pytest.approx(np.std([1 / 3, 1]))


def test_disparity_counts_missing_outcomes_as_rejected(spark):
    data = [("g1", 1), ("g1", None), ("g1", 0), ("g2", 1), ("g2", 1), (None, 0)]
    df = spark.createDataFrame(data, "g string, y int")
    got = {r["group"]: tuple(r)[1:] for r in gf.demographic_disparity(df, "y", "g", "1").collect()}
    assert got == {"g1": (1, 2, 1 / 3, 1.0, True), "g2": (2, 0, 2 / 3, 0.0, False)}


@pytest.mark.parametrize("data, message", [([("a", 1)], "no rejected"), ([("a", 0)], "no accepted")])
def test_disparity_guards(spark, data, message):
    df = spark.createDataFrame(data, "g string, y int")
    with pytest.raises(Exception, match=message):
        gf.demographic_disparity(df, "y", "g", 1).collect()
    with pytest.raises(ValueError):
        gf.demographic_disparity(df.limit(0), "y", "g", 1)


@pytest.mark.parametrize("slot", [512, 3, 1])
def test_pairs_are_made_once(spark, monkeypatch, slot):
    monkeypatch.setattr(pairing, "SLOT", slot)
    rows = [("x", i, -i) for i in range(23)] + [("y", i, i) for i in range(2)] + [("z", 0, 0)]
    df = spark.createDataFrame(rows, "c string, k int, v int")
    got = [(r["c"], frozenset((r["a"]["k"], r["b"]["k"]))) for r in unordered_pairs(df, ["c"], "k").collect()]
    want = {(c, frozenset((i, j))) for c, i, _ in rows for d, j, _ in rows if c == d and i < j}
    assert set(got) == want and len(got) == len(want)
    alone = unordered_pairs(df.where("c = 'x'").select("k", "v"), [], "k")
    assert alone.count() == 23 * 22 / 2
    left = df.where("c = 'x'").select(F.col("k").alias("a"))
    right = df.where("c = 'x'").select(F.col("k").alias("b"))
    assert grid(left, right, "a", "b").distinct().count() == 23 * 23
    assert unordered_pairs(df.limit(0), ["c"], "k").count() == 0


def test_running_totals_are_spread_evenly(spark):
    """Texts with one beginning, and numbers that differ by little against their size."""
    texts = spark.range(40_000).select(
        F.lit("url").alias("column"),
        F.concat(F.lit("https://example.org/page/"), F.col("id").cast("string")).alias("value"),
        F.lit(None).cast("double").alias("number"),
        (F.col("id") % 7 + 1).alias("n"),
    )
    numbers = spark.range(40_000).select(
        F.lit("id").alias("column"),
        (F.lit(10**12) + F.col("id")).cast("string").alias("value"),
        (F.lit(10**12) + F.col("id")).cast("double").alias("number"),
        (F.col("id") % 5 + 1).alias("n"),
    )
    out = running_total(texts.unionByName(numbers), "n", "upto")
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * 80_000 / min(8, max(len(sizes), 1)) or len(sizes) == 1
    rows = sorted(out.collect(), key=lambda r: (r["column"], r["number"] or 0, r["value"]))
    total = {"url": 0, "id": 0}
    for r in rows:
        total[r["column"]] += r["n"]
        assert r["upto"] == total[r["column"]]


def test_wide_pearson_equals_few_columns_at_a_time(spark):
    r = np.random.default_rng(3)
    data = r.normal(1e6, 1, (300, 11)) + r.normal(0, 1, (300, 1))
    data[:, 3] = 0.1
    rows = [[None if q < 0.1 else float(x) for x, q in zip(row, r.random(11), strict=True)] for row in data]
    rows = [[*row[:10], None] for row in rows]
    names = [f"c.{i}" for i in range(11)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names))
    got = scores(gf.pearson_matrix(df, diagonal=True))
    assert len(got) == 121
    few = scores(gf.pearson_matrix(df, names[:3] + [names[9]], diagonal=True))
    for key, value in few.items():
        assert got[key] == (None if value is None else pytest.approx(value, abs=1e-9))
    assert got["c.3", "c.4"] is None and got["c.10", "c.2"] is None
    nothing = scores(gf.pearson_matrix(df.limit(0), diagonal=True))
    assert len(nothing) == 121 and set(nothing.values()) == {None}
    plan = gf.pearson_matrix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_wide_pearson_adds_up_one_matrix(spark, monkeypatch):
    """No row is spread into tiles; tiles, for still more columns, give the same."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    r = np.random.default_rng(4)
    data = r.normal(1e6, 1, (400, 9)) + r.normal(0, 1, (400, 1))
    data[:, 2] = 0.1
    full = [[float(x) for x in row] for row in data]
    # gaps in some columns, a NaN, and two columns that never share a row
    gaps = [
        [*row[:4], *[None if q < 0.2 else x for x, q in zip(row[4:7], r.random(3), strict=True)],
         row[7] if k % 2 else None, float("nan") if k % 2 else row[8]]
        for k, row in enumerate(full)
    ]
    schema = ", ".join(f"c{i} double" for i in range(9))
    for rows in (full, gaps, [[*row[:8], None] for row in full], []):
        df = spark.createDataFrame(rows, schema).repartition(3)
        found = gf.pearson_matrix(df, diagonal=True)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        got = scores(found)
        assert len(got) == 81 and spark.conf.get(limit) == before
        with monkeypatch.context() as patch:
            patch.setattr(gf.operators.association, "WIDE", 4)
            tiles = scores(gf.pearson_matrix(df, diagonal=True))
        clean = np.array([[np.nan if x is None else x for x in row] for row in rows]).reshape(-1, 9)
        for i in range(9):
            for j in range(9):
                both = clean[~np.isnan(clean[:, i]) & ~np.isnan(clean[:, j])][:, [i, j]]
                if 2 in (i, j) or len(both) == 0:
                    want = None
                else:
                    want = pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)
                assert got[f"c{i}", f"c{j}"] == want
                assert tiles[f"c{i}", f"c{j}"] == want


PARTS = [
    lambda d: d.limit(1).collect(),
    lambda d: d.head(),
    lambda d: d.take(2),
    lambda d: d.show(),
    lambda d: d.count(),
    lambda d: d.select(d.columns[-1]).limit(1).collect(),
    lambda d: d.collect(),
]


@pytest.mark.parametrize("part", range(len(PARTS)))
def test_guards_fire_whatever_is_read(spark, part):
    people = spark.createDataFrame(
        [(1, "a", "x"), (1, "b", "y"), (2, "a", "y")], "id int, city string, job string"
    )
    one = spark.createDataFrame([(1, "a"), (2, "a")], "id int, city string")
    broken = [
        gf.attribute_risks(people, "id", ["city", "job"]),
        gf.row_risks(people, "id", ["city", "job"]),
        gf.combination_risks(people, "id", ["city", "job"]),
        gf.class_distribution(one, "city"),
        gf.imbalance_degree(one, "city"),
        gf.demographic_disparity(people, "job", "city", "nobody"),
        gf.equivalence_classes(people.where("id > 9"), ["city"]),
        gf.k_anonymity(people.where("id > 9"), ["city"]),
        gf.entropy_risk(people.where("id > 9"), ["city"]),
        gf.l_diversity(people.where("id > 9"), ["city"], "job"),
        gf.dataset_risk(people.where("id > 9"), "id", ["city", "job"]),
    ]
    for df in broken:
        with pytest.raises(Exception, match="unique|only one class|no accepted|no data left"):
            PARTS[part](df)


# Upper five and one per cent points of the chi-square distribution by degrees of freedom.
CHI_SQUARE_POINTS = {
    1: (3.841459, 6.634897), 2: (5.991465, 9.210340), 3: (7.814728, 11.344867), 5: (11.070498, 15.086272),
    10: (18.307038, 23.209251), 30: (43.772972, 50.892181), 100: (124.342113, 135.806723),
}


def test_chi_square_tail_has_the_known_points(spark):
    rows = [(d, x, p) for d, points in CHI_SQUARE_POINTS.items() for x, p in zip(points, (0.05, 0.01), strict=True)]
    rows += [(2, x, math.exp(-x / 2)) for x in (0.0, 0.3, 3.9, 4.1, 60.0, 700.0)]
    rows += [(4, x, math.exp(-x / 2) * (1 + x / 2)) for x in (0.5, 5.9, 6.1, 50.0)]
    rows += [(1, x, math.erfc(math.sqrt(x / 2))) for x in (0.01, 1.0, 2.9, 3.1, 40.0)]
    df = spark.createDataFrame(rows, "d long, x double, p double")
    for r in df.select("*", chi_square_tail(F.col("x"), F.col("d")).alias("q")).collect():
        table_digits = r["p"] in (0.05, 0.01)
        assert r["q"] == pytest.approx(r["p"], rel=2e-6 if table_digits else 1e-10)
    middle = spark.createDataFrame([(10_000, 9_999.333338)], "d long, x double")
    assert middle.select(chi_square_tail(F.col("x"), F.col("d"))).first()[0] == pytest.approx(0.5, abs=1e-6)


def test_chi_square_of_a_table(spark):
    """Two by two with the correction, three by two, a missing value, one value."""
    data = [("a", "x", "u", "k")] * 12 + [("a", "y", "v", "k")] * 5 + [("b", "x", "w", "k")] * 7 + [("b", "y", "u", "k")] * 9
    data += [(None, "x", None, "k"), ("a", None, "u", "k")]
    df = spark.createDataFrame(data, "p string, y string, q string, one string")
    got = {r["feature"]: r for r in gf.chi_square_independence(df, "y", ["p", "q", "one"]).collect()}

    def plain(column, correct):
        pairs = Counter((r[column], r[1]) for r in data if r[column] and r[1])
        n = sum(pairs.values())
        left, right = Counter(), Counter()
        for (a, b), k in pairs.items():
            left[a] += k
            right[b] += k
        out = 0.0
        for a in left:
            for b in right:
                e = left[a] * right[b] / n
                d = abs(pairs[a, b] - e)
                out += (d - min(0.5, d) if correct else d) ** 2 / e
        return out, n

    assert (got["p"]["chi2"], got["p"]["n"]) == (pytest.approx(plain(0, True)[0]), plain(0, True)[1])
    assert (got["q"]["chi2"], got["q"]["n"]) == (pytest.approx(plain(2, False)[0]), plain(2, False)[1])
    assert got["p"]["p_value"] == pytest.approx(math.erfc(math.sqrt(got["p"]["chi2"] / 2)))
    assert got["q"]["degrees"] == 2 and got["q"]["p_value"] == pytest.approx(math.exp(-got["q"]["chi2"] / 2))
    assert (got["one"]["chi2"], got["one"]["degrees"], got["one"]["p_value"]) == (0.0, 0, None)
    assert gf.chi_square_independence(df.limit(0), "y", ["p"]).collect() == []

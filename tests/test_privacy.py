"""Privacy metrics against row-by-row definitions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import gaugeframe as gf
from gaugeframe.plans import sizing


def people(n=120, seed=2):
    """Rows with one hot class, unknown marks and missing values."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        city = "hot" if rng.random() < 0.4 else f"c{rng.integers(6)}"
        job = ["clerk", "cook", "?", None][rng.choice(4, p=[0.5, 0.3, 0.1, 0.1])]
        ill = None if rng.random() < 0.05 else f"d{rng.integers(4)}"
        rows.append((i, city, job, ill, int(rng.integers(3))))
    return rows


SCHEMA = "id int, city string, job string, ill string, age int"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(people(), SCHEMA).repartition(7).persist()


def known(*columns):
    return [r for r in people() if all(r[c] not in (None, "?") for c in columns)]


def stats(values):
    return min(values), max(values), np.mean(values), np.median(values)


def test_k_anonymity(df):
    sizes = Counter((r[1], r[2]) for r in known(1, 2)).values()
    k, low, high, mean, median = gf.k_anonymity(df, ["city", "job"]).first()
    want = stats(list(sizes))
    assert (k, low, high, median) == (want[0], want[0], want[1], int(want[3]))
    assert mean == pytest.approx(want[2])
    histogram = {r["bucket"]: r["n_classes"] for r in gf.k_anonymity_histogram(df, ["city", "job"]).collect()}
    assert histogram == Counter(float(s) for s in sizes)


def test_unknown_marks_do_not_leak(df):
    gf.k_anonymity(df, ["job"]).collect()
    assert df.filter("job = '?'").count() > 0


def test_l_diversity(df):
    groups = defaultdict(set)
    for r in known(1, 2, 3):
        groups[r[1], r[2]].add(r[3])
    want = stats([len(g) for g in groups.values()])
    got = gf.l_diversity(df, ["city", "job"], "ill").first()
    assert (got["l"], got["max"], got["median"]) == (want[0], want[1], int(want[3]))
    assert got["mean"] == pytest.approx(want[2])


def class_distances():
    rows = known(1, 2, 3)
    whole = Counter(r[3] for r in rows)
    groups = defaultdict(Counter)
    for r in rows:
        groups[r[1], r[2]][r[3]] += 1
    out = {}
    for key, group in groups.items():
        n = sum(group.values())
        out[key] = 0.5 * sum(abs(group[s] / n - whole[s] / len(rows)) for s in whole)
    return out


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_t_closeness(df, broadcast):
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    want = class_distances()
    got = {(r["city"], r["job"]): r["t"] for r in gf.class_distances(df, ["city", "job"], "ill").collect()}
    assert got == {key: pytest.approx(t) for key, t in want.items()}
    low, high, mean, median = stats(list(want.values()))
    row = gf.t_closeness(df, ["city", "job"], "ill").first()
    df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tuple(row) == pytest.approx((high, low, high, mean, median))


def test_sensitive_column_may_be_a_quasi_identifier(df):
    assert gf.l_diversity(df, ["ill"], "ill").first()["max"] == 1
    n = Counter(r[3] for r in known(3))
    want = 1 - min(n.values()) / sum(n.values())
    assert gf.t_closeness(df, ["ill"], "ill").first()["t"] == pytest.approx(want)


def test_entropy_risk(df):
    sizes = list(Counter((r[1], r[2]) for r in known(1, 2)).values())
    low, high, mean, median = stats([math.log2(s) for s in sizes])
    want = (sum(math.log2(s) for s in sizes) / sum(sizes), low, high, mean, median)
    assert tuple(gf.entropy_risk(df, ["city", "job"]).first()) == pytest.approx(want)
    buckets = gf.entropy_risk_histogram(df, ["city", "job"]).collect()
    assert sum(r["n_classes"] for r in buckets) == len(sizes)


def test_class_guards(spark, df):
    lost = spark.createDataFrame([("?", "a"), (None, "b")], "q string, s string")
    for compute in (
        lambda: gf.k_anonymity(lost, ["q"]),
        lambda: gf.l_diversity(lost, ["q"], "s"),
        lambda: gf.t_closeness(lost, ["q"], "s"),
        lambda: gf.entropy_risk(lost, ["q"]),
    ):
        with pytest.raises(Exception, match="no data left"):
            compute().collect()
    for wrong in (["nope"], []):
        with pytest.raises(ValueError):
            gf.k_anonymity(df, wrong)
    with pytest.raises(ValueError, match="nope"):
        gf.l_diversity(df, ["city"], "nope")


def pairwise_scores(rows, qis):
    """Risk of each row by comparing it with every other."""
    n, out = len(rows), {}
    for r in rows:
        def share(*columns):
            return sum(all(o[c] == r[c] for c in columns) for o in rows)

        if len(qis) == 1:
            a = share(qis[0])
            product = a / n * (1 - 1 / a)
        else:
            product = 1.0
            for x, y in zip(qis, qis[1:]):
                a, b, ab = share(x), share(y), share(x, y)
                product *= a / n * (1 - 1 / a) * (ab / a) * (1 - 1 / b)
        out[r[0]] = 1 - product
    return out


NAMES = {1: "city", 2: "job", 4: "age"}


@pytest.mark.parametrize("qis", [[1], [1, 4], [1, 2, 4], [4, 1, 2]])
@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, 0])
def test_combination_risk_equals_pairwise_definition(df, monkeypatch, qis, limit):
    monkeypatch.setattr(sizing.few_combinations, "__defaults__", (limit,))
    rows = [r for r in people() if all(r[c] is not None for c in qis)]
    want = pairwise_scores(rows, qis)
    names = [NAMES[c] for c in qis]
    got = {r["id"]: (r["score"], r["risk"]) for r in gf.row_risks(df, "id", names).collect()}
    assert got.keys() == want.keys()
    for key, score in want.items():
        assert got[key][0] == pytest.approx(score, abs=1e-12)
    risks = [r for _, r in got.values()]
    row = gf.combination_risk_statistics(df, "id", names).first()
    assert row["dataset_risk"] == pytest.approx(math.sqrt(np.mean(np.square(risks))))
    assert row["mean"] == pytest.approx(np.mean(risks)) and row["std"] == pytest.approx(np.std(risks))
    assert [row[c] for c in ("min", "p25", "p50", "p75", "max")] == pytest.approx(
        list(np.percentile(risks, [0, 25, 50, 75, 100]))
    )


def test_order_of_quasi_identifiers(df):
    def total(names):
        return gf.combination_risks(df, "id", names).selectExpr("sum(score * n)").first()[0]

    forward = total(["city", "job", "age"])
    assert total(["age", "job", "city"]) == pytest.approx(forward, abs=1e-9)
    assert abs(total(["job", "city", "age"]) - forward) > 1e-6


@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, 0])
def test_attribute_risk_equals_pairwise_definition(df, monkeypatch, limit):
    monkeypatch.setattr(sizing.broadcast_if_small, "__defaults__", (limit,))
    rows = [r for r in people() if r[1] is not None and r[2] is not None]
    got = defaultdict(dict)
    for r in gf.row_attribute_risks(df, "id", ["city", "job"]).collect():
        got[r["qi"]][r["id"]] = r["score"]
    for column in (1, 2):
        want = pairwise_scores(rows, [column])
        assert got[NAMES[column]] == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    table = {r["qi"]: r for r in gf.attribute_risk_statistics(df, "id", ["city", "job"]).collect()}
    risks = [round(v, 2) for v in pairwise_scores(rows, [1]).values()]
    assert table["city"]["mean"] == pytest.approx(np.mean(risks))


@pytest.mark.parametrize("combined", [False, True])
def test_risk_boxes_and_fliers(df, combined):
    risks = [r["risk"] for r in gf.row_risks(df, "id", ["city"]).collect()]
    q1, median, q3 = np.percentile(risks, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [r for r in risks if low <= r <= high]
    box = gf.risk_box_plot(df, "id", ["city"], combined=combined).first()
    want = (min([*inside, q1]), q1, median, q3, max([*inside, q3]), len(risks) - len(inside))
    assert tuple(box)[1:] == pytest.approx(want)
    fliers = gf.risk_fliers(df, "id", ["city"], combined=combined).collect()
    assert sum(r["n"] for r in fliers) == want[-1]


def test_risk_guards(spark, df):
    repeated = spark.createDataFrame([(1, "a"), (1, "b")], "id int, q string")
    missing = spark.createDataFrame([(1, "a"), (None, "b")], "id int, q string")
    flat = spark.createDataFrame([(1, "a"), (2, "a")], "id int, q string")
    many = spark.range(150).selectExpr("id", "id AS q")
    for compute in (gf.attribute_risks, gf.combination_risks):
        for bad in (repeated, missing):
            with pytest.raises(Exception, match="not unique"):
                compute(bad, "id", ["q"]).collect()
        with pytest.raises(Exception, match="only one value"):
            compute(flat, "id", ["q"]).collect()
        with pytest.raises(ValueError):
            compute(df, "nope", ["city"])
        with pytest.raises(ValueError):
            compute(df, "id", [])
    with pytest.raises(Exception, match="too many values"):
        gf.attribute_risks(many, "id", ["q"]).collect()
    assert gf.combination_risks(many, "id", ["q"]).count() == 150
    with pytest.raises(Exception, match="no data left"):
        gf.combination_risk_statistics(flat.limit(0), "id", ["q"]).collect()
    assert gf.combination_risks(repeated, "id", ["q"], check_id=False).count() == 2


def test_box_summary_ends_at_the_data(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert tuple(gf.box_summary(df, ["x"]).first()) == ("x", 1.0, 2.0, 3.0, 4.0, 4.0)


def test_noise_is_laplace(spark):
    df = spark.range(200_000).selectExpr("id", "CAST(0 AS DOUBLE) AS x")
    for key in (None, ["id"]):
        noisy = gf.add_laplace_noise(df, ["x"], epsilon=0.5, key=key)
        row = gf.noise_statistics(noisy, ["x"]).first()
        assert (row["mean_before"], row["var_before"]) == (0.0, 0.0)
        assert row["mean_after"] == pytest.approx(0.0, abs=0.05)
        assert row["var_after"] == pytest.approx(2 / 0.5**2, rel=0.05)


def test_keyed_noise_ignores_partitioning(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else "s") for i in range(20)], "id int, x double, s string")

    def run(frame, seed):
        noisy = gf.add_laplace_noise(frame, ["x"], key=["id"], seed=seed)
        return {r["id"]: r["noisy_x"] for r in noisy.collect()}

    first = run(df, "a")
    assert first == run(df.repartition(6), "a") and first != run(df, "b")
    assert 3 not in first and len(first) == 19


def test_noise_guards(spark):
    df = spark.createDataFrame([(1.0, "s", None)], "x double, s string, n int")
    for epsilon in (0, -1.0, float("nan")):
        with pytest.raises(ValueError, match="epsilon"):
            gf.add_laplace_noise(df, ["x"], epsilon)
    with pytest.raises(ValueError, match="not numeric"):
        gf.add_laplace_noise(df, ["s"])
    with pytest.raises(ValueError, match="no complete row"):
        gf.add_laplace_noise(df, ["x"])

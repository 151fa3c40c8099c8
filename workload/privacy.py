"""Anonymity, re-identification risk and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

import gaugeframe as gf

from .registry import new_folder, query, rounded, table

QIS = ["c_nationkey", "c_mktsegment"]


def customers_with_marks(spark, sf_dir):
    """Some segments unknown ("?"), and whether the account is overdrawn."""
    c = table(spark, sf_dir, "customer")
    return c.withColumn(
        "c_mktsegment", F.when(F.col("c_acctbal") >= 9000, "?").otherwise(F.col("c_mktsegment"))
    ).withColumn("debtor", F.col("c_acctbal") < 0)


KNOWN = """
WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal < 0 AS debtor FROM customer
           WHERE c_acctbal < 9000),
ec AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, count(DISTINCT debtor) AS l
       FROM c GROUP BY c_nationkey, c_mktsegment),
q AS (SELECT debtor, count(*)::DOUBLE / (SELECT count(*) FROM c) AS q FROM c GROUP BY debtor),
t AS (SELECT ec.c_nationkey, ec.c_mktsegment, ec.n,
             0.5 * sum(abs(coalesce(s.n, 0) / ec.n::DOUBLE - q.q)) AS t
      FROM ec CROSS JOIN q
      LEFT JOIN (SELECT c_nationkey, c_mktsegment, debtor, count(*) AS n FROM c GROUP BY ALL) AS s
        ON s.c_nationkey = ec.c_nationkey AND s.c_mktsegment = ec.c_mktsegment AND s.debtor = q.debtor
      GROUP BY ec.c_nationkey, ec.c_mktsegment, ec.n)
"""


@query("equivalence_classes", KNOWN + "SELECT c_nationkey, c_mktsegment, n FROM ec")
def equivalence_classes(spark, sf_dir):
    return gf.equivalence_classes(customers_with_marks(spark, sf_dir), QIS)


@query("k_anonymity", KNOWN + """
SELECT min(n) AS k, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean,
       trunc(quantile_cont(n::DOUBLE, 0.5))::BIGINT AS median FROM ec
""")
def k_anonymity(spark, sf_dir):
    return rounded(gf.k_anonymity(customers_with_marks(spark, sf_dir), QIS))


@query("l_diversity", KNOWN + """
SELECT min(l) AS l, min(l) AS min, max(l) AS max, round(avg(l), 6) AS mean,
       trunc(quantile_cont(l::DOUBLE, 0.5))::BIGINT AS median FROM ec
""")
def l_diversity(spark, sf_dir):
    return rounded(gf.l_diversity(customers_with_marks(spark, sf_dir), QIS, "debtor"))


@query("class_distances", KNOWN + "SELECT c_nationkey, c_mktsegment, n, round(t, 6) AS t FROM t")
def class_distances(spark, sf_dir):
    return rounded(gf.class_distances(customers_with_marks(spark, sf_dir), QIS, "debtor"))


@query("t_closeness", KNOWN + """
SELECT round(max(t), 6) AS t, round(min(t), 6) AS min, round(max(t), 6) AS max,
       round(avg(t), 6) AS mean, round(quantile_cont(t, 0.5), 6) AS median FROM t
""")
def t_closeness(spark, sf_dir):
    return rounded(gf.t_closeness(customers_with_marks(spark, sf_dir), QIS, "debtor"))


@query("entropy_risk", KNOWN + """
SELECT round(sum(log2(n)) / sum(n)::DOUBLE, 6) AS entropy_risk, round(min(log2(n)), 6) AS min,
       round(max(log2(n)), 6) AS max, round(avg(log2(n)), 6) AS mean,
       round(quantile_cont(log2(n), 0.5), 6) AS median FROM ec
""")
def entropy_risk(spark, sf_dir):
    return rounded(gf.entropy_risk(customers_with_marks(spark, sf_dir), QIS))


@query("privacy_histograms", KNOWN + """
SELECT 'k_anonymity' AS metric, n::DOUBLE AS bucket, count(*) AS n_classes FROM ec GROUP BY n
UNION ALL SELECT 'l_diversity', l::DOUBLE, count(*) FROM ec GROUP BY l
UNION ALL SELECT 't_closeness', round(t, 2), count(*) FROM t GROUP BY round(t, 2)
UNION ALL SELECT 'entropy_risk', round(log2(n), 2), count(*) FROM ec GROUP BY round(log2(n), 2)
""")
def privacy_histograms(spark, sf_dir):
    c = customers_with_marks(spark, sf_dir)
    return (
        gf.k_anonymity_histogram(c, QIS)
        .unionByName(gf.l_diversity_histogram(c, QIS, "debtor"))
        .unionByName(gf.t_closeness_histogram(c, QIS, "debtor"))
        .unionByName(gf.entropy_risk_histogram(c, QIS))
    )


@query("l_diversity_lineitem", """
WITH ec AS (SELECT l_returnflag, l_linestatus, l_suppkey, count(DISTINCT l_quantity) AS l
            FROM lineitem GROUP BY ALL)
SELECT min(l) AS l, min(l) AS min, max(l) AS max, round(avg(l), 6) AS mean,
       trunc(quantile_cont(l::DOUBLE, 0.5))::BIGINT AS median FROM ec
""")
def l_diversity_lineitem(spark, sf_dir):
    qis = ["l_returnflag", "l_linestatus", "l_suppkey"]
    return rounded(gf.l_diversity(table(spark, sf_dir, "lineitem"), qis, "l_quantity"))


@query("t_closeness_lineitem", """
WITH n AS (SELECT l_suppkey AS e, l_returnflag AS s, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
ec AS (SELECT e, sum(n) AS total FROM n GROUP BY e),
q AS (SELECT s, sum(n) / (SELECT sum(n) FROM n) AS q FROM n GROUP BY s),
t AS (SELECT ec.e, 0.5 * sum(abs(coalesce(n.n, 0) / ec.total - q.q)) AS t
      FROM ec CROSS JOIN q LEFT JOIN n ON n.e = ec.e AND n.s = q.s GROUP BY ec.e)
SELECT round(max(t), 6) AS t, round(min(t), 6) AS min, round(max(t), 6) AS max,
       round(avg(t), 6) AS mean, round(quantile_cont(t, 0.5), 6) AS median FROM t
""")
def t_closeness_lineitem(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return rounded(gf.t_closeness(lineitem, ["l_suppkey"], "l_returnflag"))


# risks of rows, straight from the counts each row sees
SINGLE = """
WITH s AS (
  SELECT c_custkey, 'c_nationkey' AS qi, c_nationkey::VARCHAR AS value,
         count(*) OVER (PARTITION BY c_nationkey) AS n, count(*) OVER () AS total FROM customer
  UNION ALL
  SELECT c_custkey, 'c_mktsegment', c_mktsegment,
         count(*) OVER (PARTITION BY c_mktsegment), count(*) OVER () FROM customer),
r AS (SELECT c_custkey, qi, value, n, 1.0::DOUBLE - n::DOUBLE / total * (1.0::DOUBLE - 1.0::DOUBLE / n) AS score
      FROM s)
"""
MULTI = """
WITH s AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, count(*) OVER ()::DOUBLE AS total,
         count(*) OVER (PARTITION BY c_nationkey)::DOUBLE AS a,
         count(*) OVER (PARTITION BY c_mktsegment)::DOUBLE AS b,
         count(*) OVER (PARTITION BY c_nationkey, c_mktsegment)::DOUBLE AS ab
  FROM customer),
r AS (SELECT *, 1.0::DOUBLE - (a / total) * (1.0::DOUBLE - 1.0::DOUBLE / a) * (ab / a) * (1.0::DOUBLE - 1.0::DOUBLE / b) AS score
      FROM s)
"""
STATS = """round(avg(risk), 6) AS mean, round(stddev_pop(risk), 6) AS std, min(risk) AS min,
       round(quantile_cont(risk, 0.25), 6) AS p25, round(quantile_cont(risk, 0.5), 6) AS p50,
       round(quantile_cont(risk, 0.75), 6) AS p75, max(risk) AS max"""


@query("attribute_risks", SINGLE + """
SELECT qi, value, count(*) AS n, round(any_value(score), 6) AS score, round(any_value(score), 2) AS risk
FROM r GROUP BY qi, value
""")
def attribute_risks(spark, sf_dir):
    return rounded(gf.attribute_risks(table(spark, sf_dir, "customer"), "c_custkey", QIS))


@query("attribute_risk_statistics", SINGLE + f"""
SELECT qi, {STATS} FROM (SELECT qi, round(score, 2) AS risk FROM r) GROUP BY qi
""")
def attribute_risk_statistics(spark, sf_dir):
    return rounded(gf.attribute_risk_statistics(table(spark, sf_dir, "customer"), "c_custkey", QIS))


@query("attribute_risk_rows", SINGLE + """
SELECT c_custkey, qi, round(score, 6) AS score, round(score, 2) AS risk FROM r
""")
def attribute_risk_rows(spark, sf_dir):
    return rounded(gf.row_attribute_risks(table(spark, sf_dir, "customer"), "c_custkey", QIS))


@query("combination_risk_statistics", MULTI + f"""
SELECT round(sqrt(avg(risk * risk)), 6) AS dataset_risk, {STATS}
FROM (SELECT round(score, 2) AS risk FROM r)
""")
def combination_risk_statistics(spark, sf_dir):
    return rounded(
        gf.combination_risk_statistics(table(spark, sf_dir, "customer"), "c_custkey", QIS)
    )


@query("dataset_risk", MULTI + """
SELECT round(sqrt(avg(round(score, 2) * round(score, 2))), 6) AS dataset_risk FROM r
""")
def dataset_risk(spark, sf_dir):
    return rounded(gf.dataset_risk(table(spark, sf_dir, "customer"), "c_custkey", QIS))


@query("combination_risk_rows", MULTI + """
SELECT c_custkey, round(score, 6) AS score, round(score, 2) AS risk FROM r
""")
def combination_risk_rows(spark, sf_dir):
    return rounded(gf.row_risks(table(spark, sf_dir, "customer"), "c_custkey", QIS))


@query("combination_risks_three", """
WITH c AS (SELECT c_nationkey AS a, c_mktsegment AS b, c_acctbal < 0 AS d FROM customer),
s AS (SELECT a, b, d, count(*) OVER ()::DOUBLE AS total,
             count(*) OVER (PARTITION BY a)::DOUBLE AS na, count(*) OVER (PARTITION BY b)::DOUBLE AS nb,
             count(*) OVER (PARTITION BY d)::DOUBLE AS nd,
             count(*) OVER (PARTITION BY a, b)::DOUBLE AS nab,
             count(*) OVER (PARTITION BY b, d)::DOUBLE AS nbd FROM c),
r AS (SELECT a, b, d, 1.0::DOUBLE
        - (na / total) * (1.0::DOUBLE - 1.0::DOUBLE / na) * (nab / na) * (1.0::DOUBLE - 1.0::DOUBLE / nb)
        * (nb / total) * (1.0::DOUBLE - 1.0::DOUBLE / nb) * (nbd / nb) * (1.0::DOUBLE - 1.0::DOUBLE / nd) AS score
      FROM s)
SELECT a AS c_nationkey, b AS c_mktsegment, d AS debtor, count(*) AS n,
       round(any_value(score), 8) AS score, round(any_value(score), 2) AS risk
FROM r GROUP BY a, b, d
""")
def combination_risks_three(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("debtor", F.col("c_acctbal") < 0)
    return rounded(gf.combination_risks(c, "c_custkey", [*QIS, "debtor"]), 8)


BOX = """
SELECT series, least(min(risk) FILTER (risk >= q1 - 1.5 * (q3 - q1)), any_value(q1)) AS whisker_lo,
       any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       greatest(max(risk) FILTER (risk <= q3 + 1.5 * (q3 - q1)), any_value(q3)) AS whisker_hi,
       count(*) FILTER (risk < q1 - 1.5 * (q3 - q1) OR risk > q3 + 1.5 * (q3 - q1)) AS n_fliers
FROM (SELECT qi AS series, round(score, 2) AS risk FROM r)
JOIN (SELECT qi AS series, quantile_cont(round(score, 2), 0.25) AS q1,
             quantile_cont(round(score, 2), 0.5) AS median,
             quantile_cont(round(score, 2), 0.75) AS q3 FROM r GROUP BY qi) USING (series)
GROUP BY series
"""


@query("risk_box_plot", SINGLE + f"""
SELECT series, round(whisker_lo, 6) AS whisker_lo, round(q1, 6) AS q1, round(median, 6) AS median,
       round(q3, 6) AS q3, round(whisker_hi, 6) AS whisker_hi, n_fliers FROM ({BOX})
""")
def risk_box_plot(spark, sf_dir):
    return rounded(gf.risk_box_plot(table(spark, sf_dir, "customer"), "c_custkey", QIS))


# a rare account class makes its risk an outlying point
RARE = """
WITH s AS (SELECT count(*) OVER (PARTITION BY rare)::DOUBLE AS n, count(*) OVER ()::DOUBLE AS total
           FROM (SELECT CASE WHEN c_acctbal < -900 THEN 'deep' ELSE 'usual' END AS rare FROM customer)),
r AS (SELECT 'rare' AS qi, 1.0::DOUBLE - n / total * (1.0::DOUBLE - 1.0::DOUBLE / n) AS score FROM s)
"""


@query("risk_fliers", RARE + f"""
SELECT f.series, f.risk, count(*) AS n
FROM (SELECT qi AS series, round(score, 2) AS risk FROM r) AS f JOIN ({BOX}) AS b USING (series)
WHERE f.risk < b.q1 - 1.5 * (b.q3 - b.q1) OR f.risk > b.q3 + 1.5 * (b.q3 - b.q1)
GROUP BY f.series, f.risk
""")
def risk_fliers(spark, sf_dir):
    rare = F.when(F.col("c_acctbal") < -900, "deep").otherwise("usual")
    c = table(spark, sf_dir, "customer").withColumn("rare", rare)
    return gf.risk_fliers(c, "c_custkey", ["rare"])


def _box_sql(source, series):
    return f"""
SELECT '{series}' AS series,
       round(least(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), any_value(q1)), 6) AS whisker_lo,
       round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3,
       round(greatest(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), any_value(q3)), 6) AS whisker_hi
FROM (SELECT {series}::DOUBLE AS v FROM {source}),
     (SELECT quantile_cont({series}::DOUBLE, 0.25) AS q1, quantile_cont({series}::DOUBLE, 0.5) AS median,
             quantile_cont({series}::DOUBLE, 0.75) AS q3 FROM {source})"""


@query("box_summary", " UNION ALL ".join(
    _box_sql("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_partkey")
))
def box_summary(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_partkey"]
    return rounded(gf.box_summary(table(spark, sf_dir, "lineitem"), columns))


EPSILON, SEED = 0.5, "7"


def noisy_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    gaps = orders.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 30000, F.col("o_orderstatus")))
    return gf.add_laplace_noise(gaps, ["o_totalprice"], EPSILON, key=["o_orderkey"], seed=SEED)


NOISY = f"""
WITH u AS (SELECT o_orderkey, o_totalprice, o_orderstatus,
                  (('0x' || substr(md5('{SEED}|o_totalprice|' || o_orderkey), 1, 12))::BIGINT + 0.5::DOUBLE)
                    / 281474976710656.0::DOUBLE - 0.5::DOUBLE AS c
           FROM orders WHERE o_totalprice > 30000),
noisy AS (SELECT o_orderkey, o_totalprice, o_orderstatus,
                 o_totalprice - 2.0::DOUBLE * sign(c) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs(c)) AS noisy_o_totalprice
          FROM u)
"""


@query("noisy_table", NOISY + """
SELECT o_orderkey, o_totalprice, o_orderstatus, round(noisy_o_totalprice, 6) AS noisy_o_totalprice FROM noisy
""")
def noisy_table(spark, sf_dir):
    return noisy_orders(spark, sf_dir).withColumn(
        "noisy_o_totalprice", F.round("noisy_o_totalprice", 6)
    )


@query("noise_statistics", NOISY + """
SELECT 'o_totalprice' AS "column", round(avg(o_totalprice), 4) AS mean_before,
       round(var_pop(o_totalprice), 1) AS var_before, round(avg(noisy_o_totalprice), 4) AS mean_after,
       round(var_pop(noisy_o_totalprice), 1) AS var_after
FROM noisy
""")
def noise_statistics(spark, sf_dir):
    stats = gf.noise_statistics(noisy_orders(spark, sf_dir), ["o_totalprice"])
    return stats.select(
        "column",
        *[F.round(c, 4).alias(c) for c in ("mean_before", "mean_after")],
        *[F.round(c, 1).alias(c) for c in ("var_before", "var_after")],
    )


@query("noise_box_plot", NOISY + _box_sql("noisy", "o_totalprice")
       + " UNION ALL " + _box_sql("noisy", "noisy_o_totalprice"))
def noise_box_plot(spark, sf_dir):
    return rounded(gf.noise_box_plot(noisy_orders(spark, sf_dir), ["o_totalprice"]))


@query("noisy_table_written", NOISY + """
SELECT o_orderkey, o_totalprice, o_orderstatus, round(noisy_o_totalprice, 6) AS noisy_o_totalprice FROM noisy
""")
def noisy_table_written(spark, sf_dir):
    path = new_folder(spark)
    gf.write_table(noisy_orders(spark, sf_dir), path)
    return spark.read.parquet(path).withColumn(
        "noisy_o_totalprice", F.round("noisy_o_totalprice", 6)
    )


@query("anonymity_guards", """
SELECT 'all' AS rows, 'no data left after dropping rows with missing values' AS guard,
       count(*) FILTER (o_orderstatus <> '?' AND o_orderpriority IS NOT NULL) = 0 AS failed FROM orders
UNION ALL SELECT 'none', 'no data left after dropping rows with missing values',
       count(*) FILTER (o_totalprice < 0) = 0 FROM orders
""")
def anonymity_guards(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = gf.anonymity_guards(orders, ["o_orderstatus"], "o_orderpriority")
    none = gf.anonymity_guards(orders.where("o_totalprice < 0"), ["o_orderstatus"])
    return found.select(F.lit("all").alias("rows"), "*").unionByName(none.select(F.lit("none").alias("rows"), "*"))


def _risk_guards_sql(name, id_column, qis):
    """Guards of ``qis``: pairs of a column and whether it holds numbers."""
    distinct = ", ".join(f"count(DISTINCT {q})" for q, _ in qis)
    numbers = ", ".join(f"count(DISTINCT {q})" for q, is_number in qis if is_number) or "0"
    return f"""
SELECT '{name}' AS name, unnest(['identifier is not unique for each row',
  'no data left after dropping rows with missing values', 'a quasi-identifier has only one value',
  'a numeric quasi-identifier has too many values']) AS guard,
  unnest([count(*) > count(DISTINCT {id_column}), count(*) = 0, least({distinct}) = 1,
          greatest({numbers}) > 100]) AS failed
FROM customer"""


RISK_GUARDS = {
    "good": ("c_custkey", [("c_mktsegment", False), ("c_nationkey", True)]),
    "bad": ("c_nationkey", [("c_custkey", True), ("c_mktsegment", False)]),
}


@query("reidentification_guards", " UNION ALL ".join(_risk_guards_sql(n, *x) for n, x in RISK_GUARDS.items()))
def reidentification_guards(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    parts = [
        gf.reidentification_guards(customer, id_column, [q for q, _ in qis]).select(F.lit(n).alias("name"), "*")
        for n, (id_column, qis) in RISK_GUARDS.items()
    ]
    return parts[0].unionByName(parts[1])

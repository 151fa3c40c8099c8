"""Correlation, cleaning steps, feature relevance and class imbalance."""

from __future__ import annotations

from pyspark.sql import functions as F

import gaugeframe as gf

from .registry import query, rounded, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pearson_sql(pairs):
    return " UNION ALL ".join(
        f"SELECT 'pearson' AS kind, '{a}' AS col_a, '{b}' AS col_b, "
        f"round(corr({a}, {b}), 6) + 0.0 AS score FROM lineitem"
        for a, b in pairs
    )


@query("pearson_matrix", _pearson_sql([(a, b) for a in MEASURES for b in MEASURES if a != b]))
def pearson_matrix(spark, sf_dir):
    return rounded(gf.pearson_matrix(table(spark, sf_dir, "lineitem"), MEASURES))


WIDE = {
    f"m{k:02d}": f"({MEASURES[k % 4]} * {k + 1} + (l_orderkey * {k + 3} + l_linenumber) % {89 + k})"
    for k in range(60)
}


def _pearson_wide_sql():
    pairs = [(a, b) for i, a in enumerate(WIDE) for b in list(WIDE)[:i]]
    columns = ", ".join(f"{x} AS {c}" for c, x in WIDE.items())
    scores = ", ".join(f'corr({a}, {b}) AS "{a}{b}"' for a, b in pairs)
    return f"""
WITH d AS (SELECT {columns} FROM lineitem), s AS (SELECT {scores} FROM d),
u AS (UNPIVOT s ON COLUMNS(*) INTO NAME pair VALUE r),
p AS (SELECT pair[1:3] AS a, pair[4:6] AS b, round(r, 6) + 0.0 AS score FROM u)
SELECT 'pearson' AS kind, a AS col_a, b AS col_b, score FROM p
UNION ALL SELECT 'pearson', b, a, score FROM p
"""


@query("pearson_wide", _pearson_wide_sql())
def pearson_wide(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select(*[F.expr(x).alias(c) for c, x in WIDE.items()])
    return rounded(gf.pearson_matrix(wide))


@query("pearson_heatmap", _pearson_sql([(a, b) for a in MEASURES for b in MEASURES]))
def pearson_heatmap(spark, sf_dir):
    return rounded(gf.pearson_matrix(table(spark, sf_dir, "lineitem"), MEASURES, diagonal=True))


def _theil_sql(source, columns):
    """U(a|b) from conditional entropies, as the textbook writes it."""
    parts = []
    for a in columns:
        for b in columns:
            if a != b:
                parts.append(f"""
SELECT 'theil_u' AS kind, '{a}' AS col_a, '{b}' AS col_b, round((
  (SELECT -sum(p * ln(p)) FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM {source}) AS p
                                FROM {source} GROUP BY {a}))
  - (SELECT sum(j.n / t.n * ln(m.n / j.n))
     FROM (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY 1, 2) AS j
     JOIN (SELECT {b} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY 1) AS m
       ON j.b IS NOT DISTINCT FROM m.b,
       (SELECT count(*)::DOUBLE AS n FROM {source}) AS t))
  / (SELECT -sum(p * ln(p)) FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM {source}) AS p
                                  FROM {source} GROUP BY {a})), 6) + 0.0 AS score""")
    return " UNION ALL ".join(parts)


def customer_texts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_nationkey").cast("string").alias("nation"),
        F.when(F.col("c_acctbal") < 9000, F.col("c_mktsegment")).alias("segment"),
        (F.col("c_acctbal") < 0).cast("string").alias("debtor"),
    )


TEXTS = """
WITH texts AS (SELECT c_nationkey::VARCHAR AS nation,
                      CASE WHEN c_acctbal < 9000 THEN c_mktsegment END AS segment,
                      (c_acctbal < 0)::VARCHAR AS debtor FROM customer)
"""


@query("theil_u", TEXTS + _theil_sql("texts", ["nation", "segment", "debtor"]))
def theil_u(spark, sf_dir):
    return rounded(gf.theil_u_matrix(customer_texts(spark, sf_dir)))


@query(
    "correlations",
    "SELECT 'pearson' AS kind, 'o_custkey' AS col_a, 'o_totalprice' AS col_b,"
    " round(corr(o_custkey, o_totalprice), 6) + 0.0 AS score FROM orders UNION ALL "
    "SELECT 'pearson', 'o_totalprice', 'o_custkey',"
    " round(corr(o_custkey, o_totalprice), 6) + 0.0 FROM orders UNION ALL "
    + _theil_sql("orders", ["o_orderstatus", "o_orderpriority"]),
)
def correlations(spark, sf_dir):
    columns = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    return rounded(gf.correlations(table(spark, sf_dir, "orders"), columns))


def orders_with_gaps(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .withColumn("o_orderpriority", F.when(F.col("o_totalprice") > 30000, F.col("o_orderpriority")))
        .withColumn("o_totalprice", F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")))
    )


ORDER_GAPS = """
WITH gaps AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                     CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS o_totalprice,
                     CASE WHEN o_totalprice > 30000 THEN o_orderpriority END AS o_orderpriority
              FROM orders)
"""


@query("impute_mean", ORDER_GAPS + """
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM gaps)), 4) AS o_totalprice
FROM gaps
""")
def impute_mean(spark, sf_dir):
    filled = gf.impute_mean(orders_with_gaps(spark, sf_dir), ["o_totalprice"])
    return rounded(filled.select("o_orderkey", "o_totalprice"), 4)


@query("impute_categorical", ORDER_GAPS + """
SELECT o_orderkey, coalesce(o_orderpriority, 'Missing') AS o_orderpriority FROM gaps
""")
def impute_categorical(spark, sf_dir):
    filled = gf.impute_categorical(orders_with_gaps(spark, sf_dir), ["o_orderpriority"])
    return filled.select("o_orderkey", "o_orderpriority")


@query("one_hot", """
SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS "o_orderstatus_F",
       (o_orderstatus = 'O')::INTEGER AS "o_orderstatus_O",
       (o_orderstatus = 'P')::INTEGER AS "o_orderstatus_P"
FROM orders
""")
def one_hot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return gf.one_hot(orders, ["o_orderstatus"])


@query("one_hot_long", """
SELECT p_partkey, 'p_name_' || p_name AS feature, 1::INTEGER AS value FROM part
UNION ALL SELECT p_partkey, 'p_brand_' || p_brand, 1 FROM part
""")
def one_hot_long(spark, sf_dir):
    return gf.one_hot_long(table(spark, sf_dir, "part"), ["p_partkey"], ["p_name", "p_brand"])


@query("label_codes", """
SELECT p_brand AS label, (row_number() OVER (ORDER BY p_brand) - 1)::INTEGER AS code
FROM (SELECT DISTINCT p_brand FROM part)
""")
def label_codes(spark, sf_dir):
    return gf.label_codes(table(spark, sf_dir, "part"), "p_brand")


@query("label_encode", """
SELECT p_partkey, p_name, (dense_rank() OVER (ORDER BY p_name) - 1)::INTEGER AS code FROM part
""")
def label_encode(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return gf.label_encode(parts, "p_name", out="code")


def _one_hot_scores(source, column, y):
    return f"""
SELECT '{column}_' || v.v AS feature,
       round(corr(CASE WHEN coalesce({column}, 'Missing') = v.v THEN 1.0::DOUBLE ELSE 0.0 END, {y}), 6)
         + 0.0 AS corr
FROM {source}, (SELECT DISTINCT coalesce({column}, 'Missing') AS v FROM {source}) AS v
GROUP BY v.v"""


@query("feature_relevance", ORDER_GAPS + """
SELECT 'o_custkey' AS feature, round(corr(o_custkey, o_totalprice), 6) + 0.0 AS corr FROM gaps
UNION ALL
SELECT 'o_orderkey', round(corr(o_orderkey, o_totalprice), 6) + 0.0 FROM gaps
UNION ALL """ + _one_hot_scores("gaps", "o_orderstatus", "o_totalprice")
    + " UNION ALL " + _one_hot_scores("gaps", "o_orderpriority", "o_totalprice"))
def feature_relevance(spark, sf_dir):
    return rounded(
        gf.feature_relevance(
            orders_with_gaps(spark, sf_dir),
            target="o_totalprice",
            categorical=["o_orderstatus", "o_orderpriority"],
            numeric=["o_custkey", "o_orderkey"],
        )
    )


@query("feature_relevance_text_target", ORDER_GAPS + """,
m AS (SELECT avg(o_totalprice) AS mean FROM gaps),
coded AS (SELECT coalesce(o_totalprice, mean) AS price, o_orderstatus,
                 dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS y
          FROM gaps, m WHERE o_orderpriority IS NOT NULL)
SELECT 'o_totalprice' AS feature, round(corr(price, y), 6) + 0.0 AS corr FROM coded
UNION ALL """ + _one_hot_scores("coded", "o_orderstatus", "y"))
def feature_relevance_text_target(spark, sf_dir):
    return rounded(
        gf.feature_relevance(
            orders_with_gaps(spark, sf_dir),
            target="o_orderpriority",
            categorical=["o_orderstatus"],
            numeric=["o_totalprice"],
        )
    )


@query("class_distribution", """
SELECT lang AS class, count(*) AS "count",
       round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 1) AS pct
FROM documents GROUP BY lang
""")
def class_distribution(spark, sf_dir):
    return gf.class_distribution(table(spark, sf_dir, "documents"), "lang")


DISTANCES = {
    "EU": "sqrt(sum(power(v - e, 2)))",
    "CH": "max(abs(v - e))",
    "KL": "sum((v + 1e-10::DOUBLE) / s * ln(((v + 1e-10::DOUBLE) / s) / (1.0::DOUBLE / k)))",
    "HE": "sqrt(0.5 * sum(power(sqrt(v) - sqrt(e), 2)))",
    "TV": "0.5 * sum(abs(v - e))",
    "CS": "sum(power(v - e, 2) / (e + 1e-10::DOUBLE))",
}


def _imbalance_sql(source, column, metric):
    """Writes the extreme distribution out as rows and measures both alike."""
    distance = DISTANCES[metric]
    return f"""
(WITH c AS (SELECT {column} AS c, count(*)::DOUBLE AS n FROM {source}
            WHERE {column} IS NOT NULL GROUP BY 1),
t AS (SELECT count(*) AS k, sum(n) AS n FROM c),
p AS (SELECT c.n / t.n AS v, 1.0::DOUBLE / t.k AS e, t.k FROM c, t),
m AS (SELECT count(*) FILTER (v < e) AS m, any_value(k) AS k, any_value(e) AS e FROM p),
x AS (SELECT CASE WHEN i <= m THEN 0.0::DOUBLE WHEN i < k THEN e ELSE 1 - (k - m - 1) * e END AS v, e, k
      FROM m, generate_series(1, 50) AS g(i) WHERE i <= k),
ps AS (SELECT v, e, k, (SELECT sum(v + 1e-10::DOUBLE) FROM p) AS s FROM p),
xs AS (SELECT v, e, k, (SELECT sum(v + 1e-10::DOUBLE) FROM x) AS s FROM x)
SELECT '{column}' AS "column", '{metric}' AS metric, m.k, m.m AS minority_classes,
       round((SELECT {distance} FROM ps) / (SELECT {distance} FROM xs) + m.m - 1, 6) AS imbalance_degree
FROM m)"""


def _register_imbalance(metric):
    sql = (
        "SELECT * FROM " + _imbalance_sql("customer", "c_mktsegment", metric)
        + " UNION ALL SELECT * FROM " + _imbalance_sql("labels", "quality", metric)
        + " UNION ALL SELECT * FROM " + _imbalance_sql("documents", "lang", metric)
    )

    @query(f"imbalance_{metric.lower()}", sql)
    def imbalance(spark, sf_dir):
        parts = [
            gf.imbalance_degree(table(spark, sf_dir, name), column, [metric])
            for name, column in (
                ("customer", "c_mktsegment"), ("labels", "quality"), ("documents", "lang"),
            )
        ]
        return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


for _metric in DISTANCES:
    _register_imbalance(_metric)


def _chi_square_sql(feature, target, source):
    return f"""
SELECT '{feature}' AS feature, round(CASE WHEN r = 2 AND c = 2 THEN yates ELSE plain END, 6) AS chi2,
       (r - 1) * (c - 1) AS degrees, n FROM (
  SELECT count(DISTINCT x) AS r, count(DISTINCT y) AS c, sum(o)::BIGINT AS n,
         sum((o - e) * (o - e) / e) AS plain,
         sum((abs(o - e) - least(0.5, abs(o - e))) * (abs(o - e) - least(0.5, abs(o - e))) / e) AS yates
  FROM (SELECT x, y, coalesce(o, 0)::DOUBLE AS o, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y)
               / sum(o) OVER ()::DOUBLE AS e
        FROM (SELECT a.x, b.y, count(s.x) AS o
              FROM (SELECT DISTINCT {feature} AS x FROM {source} WHERE {feature} IS NOT NULL AND {target} IS NOT NULL) AS a
              CROSS JOIN (SELECT DISTINCT {target} AS y FROM {source} WHERE {feature} IS NOT NULL AND {target} IS NOT NULL) AS b
              LEFT JOIN (SELECT {feature} AS x, {target} AS y FROM {source}) AS s ON s.x = a.x AND s.y = b.y
              GROUP BY ALL)))"""


CHI_SOURCE = """(SELECT *, o_totalprice > 200000 AS dear, o_custkey % 2 = 0 AS even, o_custkey % 40 AS many
FROM orders)"""


@query(
    "chi_square",
    " UNION ALL ".join(
        _chi_square_sql(f, "o_orderstatus", CHI_SOURCE) for f in ("o_orderpriority", "dear", "many")
    ),
)
def chi_square(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "*", "o_totalprice > 200000 AS dear", "o_custkey % 40 AS many"
    )
    found = gf.chi_square_independence(orders, "o_orderstatus", ["o_orderpriority", "dear", "many"])
    return rounded(found.drop("p_value"))


@query("chi_square_corrected", _chi_square_sql("dear", "even", CHI_SOURCE))
def chi_square_corrected(spark, sf_dir):
    """Two values on each side."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "*", "o_totalprice > 200000 AS dear", "o_custkey % 2 = 0 AS even"
    )
    return rounded(gf.chi_square_independence(orders, "even", ["dear"]).drop("p_value"))

"""Representation, outcome rates and disparities."""

from __future__ import annotations

from pyspark.sql import functions as F

import gaugeframe as gf

from .registry import query, rounded, table


def _value_counts_sql(source, column):
    return (
        f"SELECT '{column}' AS \"column\", {column}::VARCHAR AS value, count(*) AS n "
        f"FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}"
    )


@query("representation_rate", f"""
WITH c AS ({_value_counts_sql("documents", "lang")} UNION ALL {_value_counts_sql("documents", "source")})
SELECT a."column", a.value AS value_a, b.value AS value_b, round(a.n::DOUBLE / b.n, 6) AS ratio
FROM c AS a JOIN c AS b ON a."column" = b."column"
 AND (a.n > b.n OR (a.n = b.n AND a.value < b.value))
""")
def representation_rate(spark, sf_dir):
    return rounded(gf.representation_rates(table(spark, sf_dir, "documents"), ["lang", "source"]))


@query("representation_cumulative", """
WITH c AS (
  SELECT 'lang' AS "column", lang AS value, 0.0::DOUBLE AS x, count(*) AS n FROM documents GROUP BY lang
  UNION ALL
  SELECT 'n_chars', n_chars::VARCHAR, n_chars::DOUBLE, count(*) FROM documents GROUP BY n_chars)
SELECT "column", value, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY "column"), 6) AS share,
       round(sum(n) OVER (PARTITION BY "column" ORDER BY x, value
                          ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (PARTITION BY "column"), 6)
         AS cum_share
FROM c
""")
def representation_cumulative(spark, sf_dir):
    return rounded(gf.representation_shares(table(spark, sf_dir, "documents"), ["lang", "n_chars"]))


def nations(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def supplier_regions(spark, sf_dir):
    """The dataset under test: the regions suppliers are in."""
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))


def customer_populations(spark, sf_dir):
    """The population it should represent: customers by region."""
    customer = table(spark, sf_dir, "customer")
    return (
        customer.join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("r_name").alias("value"))
        .agg(F.count("*").alias("population"))
    )


REAL = """
pop AS (SELECT r_name AS value, count(*)::DOUBLE AS n
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name),
rr AS (SELECT 'r_name' AS "column", a.value AS value_a, b.value AS value_b, a.n / b.n AS ratio
         FROM pop AS a JOIN pop AS b ON a.value <> b.value)"""


@query("real_representation", f"""
WITH {REAL} SELECT "column", value_a, value_b, round(ratio, 6) AS ratio FROM rr
""")
def real_representation(spark, sf_dir):
    return rounded(gf.real_representation_rates(customer_populations(spark, sf_dir), "r_name"))


@query("compare_representation", f"""
WITH {REAL},
sup AS (SELECT r_name AS value, count(*)::DOUBLE AS n
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name),
ds AS (SELECT a.value AS value_a, b.value AS value_b, a.n / b.n AS ratio
       FROM sup AS a JOIN sup AS b ON a.n > b.n OR (a.n = b.n AND a.value < b.value))
SELECT rr."column", value_a, value_b, round(rr.ratio, 6) AS real_ratio,
       round(ds.ratio, 6) AS dataset_ratio, round(abs(rr.ratio - ds.ratio), 6) AS abs_diff,
       round(rr.ratio / (rr.ratio + ds.ratio) * 100, 6) AS pct_real,
       round(ds.ratio / (rr.ratio + ds.ratio) * 100, 6) AS pct_dataset
FROM rr JOIN ds USING (value_a, value_b)
""")
def compare_representation(spark, sf_dir):
    dataset = gf.representation_rates(supplier_regions(spark, sf_dir), ["r_name"])
    real = gf.real_representation_rates(customer_populations(spark, sf_dir), "r_name")
    return rounded(gf.compare_representation(dataset, real))


def events_by_user(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .withColumn("user_id", F.when(F.col("value") >= 2, F.col("user_id")))
        .withColumn("event_type", F.when(F.col("value") < 80, F.col("event_type")))
    )


RATES = """
WITH e AS (SELECT user_id, event_type FROM events WHERE value >= 2 AND value < 80),
g AS (SELECT user_id, count(*) AS total FROM e GROUP BY user_id),
k AS (SELECT DISTINCT event_type FROM e),
n AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT g.user_id, k.event_type, coalesce(n.n, 0) AS n, coalesce(n.n, 0)::DOUBLE / total AS rate
      FROM g CROSS JOIN k LEFT JOIN n ON n.user_id = g.user_id AND n.event_type = k.event_type)
"""


@query("statistical_rate", RATES + """
SELECT user_id AS "group", event_type AS class, n, round(rate, 6) AS rate FROM r
""")
def statistical_rate(spark, sf_dir):
    return rounded(gf.statistical_rates(events_by_user(spark, sf_dir), "event_type", "user_id"))


@query("rate_deviation", RATES + """
SELECT event_type AS class, round(stddev_pop(rate), 6) AS tsd FROM r GROUP BY event_type
""")
def rate_deviation(spark, sf_dir):
    return rounded(gf.rate_deviation(events_by_user(spark, sf_dir), "event_type", "user_id"))


def labelled_documents(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.select("doc_id", "lang", "source").join(labels, "doc_id", "left")


@query("rate_deviation_sparse", """
WITH e AS (SELECT source AS g, toxic AS c FROM documents JOIN labels USING (doc_id)),
grid AS (SELECT g, c FROM (SELECT DISTINCT g FROM e) CROSS JOIN (SELECT DISTINCT c FROM e)),
r AS (SELECT grid.g, grid.c, (SELECT count(*) FROM e WHERE e.g = grid.g AND e.c = grid.c)::DOUBLE
             / (SELECT count(*) FROM e WHERE e.g = grid.g) AS rate FROM grid)
SELECT c AS class, round(stddev_pop(rate), 6) AS tsd FROM r GROUP BY c
""")
def rate_deviation_sparse(spark, sf_dir):
    return rounded(gf.rate_deviation(labelled_documents(spark, sf_dir), "toxic", "source"))


@query("demographic_disparity", """
WITH d AS (SELECT lang, coalesce(quality = 1, false) AS ok
           FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM d),
g AS (SELECT lang, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected
      FROM d GROUP BY lang)
SELECT lang AS "group", g.accepted, g.rejected,
       round(g.accepted::DOUBLE / t.accepted, 6) AS share_of_accepted,
       round(g.rejected::DOUBLE / t.rejected, 6) AS share_of_rejected,
       g.rejected::DOUBLE / t.rejected > g.accepted::DOUBLE / t.accepted AS disparity
FROM g, t
""")
def demographic_disparity(spark, sf_dir):
    return rounded(
        gf.demographic_disparity(labelled_documents(spark, sf_dir), "quality", "lang", "1")
    )


def _disparity_guards_sql(accepted):
    return f"""
SELECT unnest(['no group left in ''o_orderpriority''', 'no accepted value ''{accepted}'' in ''o_orderstatus''',
               'no rejected value in ''o_orderstatus''']) AS guard,
       unnest([count(o_orderpriority) = 0, count(*) FILTER (o_orderstatus = '{accepted}') = 0,
               count(*) FILTER (o_orderstatus IS DISTINCT FROM '{accepted}') = 0]) AS failed
FROM orders WHERE o_orderpriority IS NOT NULL"""


@query("disparity_guards", _disparity_guards_sql("F") + " UNION ALL " + _disparity_guards_sql("nobody"))
def disparity_guards(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = [gf.disparity_guards(orders, "o_orderstatus", "o_orderpriority", x) for x in ("F", "nobody")]
    return found[0].unionByName(found[1])


GUARDED = {"o_orderstatus": False, "o_custkey": True, "o_orderkey": True, "constant": True}


def _imbalance_guards_sql(column, is_number):
    many = [f"'''{column}'' has too many values for classes'"] if is_number else []
    above = ["k > 100"] if is_number else []
    guards = [
        f"'no valid data in ''{column}'' after dropping missing values'",
        f"'''{column}'' needs at least two rows'",
        f"'''{column}'' has only one class'",
        *many,
        f"'''{column}'' has more than 50 classes'",
    ]
    failed = ["n = 0", "n < 2", "k < 2", *above, "k > 50"]
    return f"""
SELECT unnest([{", ".join(guards)}]) AS guard, unnest([{", ".join(failed)}]) AS failed
FROM (SELECT count(DISTINCT {column}) AS k, count({column}) AS n
      FROM (SELECT *, 1 AS constant FROM orders))"""


@query("imbalance_guards", " UNION ALL ".join(_imbalance_guards_sql(c, x) for c, x in GUARDED.items()))
def imbalance_guards(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("constant", F.lit(1))
    parts = [gf.imbalance_guards(orders, c) for c in GUARDED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

"""Profile and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

import gaugeframe as gf

from .registry import query, rounded, table


def events_with_gaps(spark, sf_dir):
    """The sample tables have no missing values; small values and some props go missing."""
    return (
        table(spark, sf_dir, "events")
        .withColumn("value", F.when(F.col("value") >= 3, F.col("value")))
        .withColumn("props", F.when(F.col("event_type") != "signup", F.col("props")))
    )


GAPS = """
gaps AS (SELECT event_id, ts, user_id, event_type,
                CASE WHEN value >= 3 THEN value END AS value,
                CASE WHEN event_type <> 'signup' THEN props END AS props
         FROM events)"""


@query("completeness_columns", f"""
WITH {GAPS}
SELECT 'value' AS "column", round(count(value) * 1.0::DOUBLE / count(*), 6) AS completeness FROM gaps
UNION ALL
SELECT 'props', round(count(props) * 1.0::DOUBLE / count(*), 6) FROM gaps
""")
def completeness_columns(spark, sf_dir):
    return rounded(gf.completeness_by_column(events_with_gaps(spark, sf_dir)))


@query("completeness_overall", f"""
WITH {GAPS}
SELECT round(avg(CASE WHEN value IS NULL OR props IS NULL THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS overall,
       'partial' AS status
FROM gaps
""")
def completeness_overall(spark, sf_dir):
    return rounded(gf.overall_completeness(events_with_gaps(spark, sf_dir)))


@query("duplicity_text", """
SELECT count(*) AS "rows", count(*) - count(DISTINCT text) AS duplicates,
       round((count(*) - count(DISTINCT text)) * 1.0::DOUBLE / count(*), 6) AS duplicity
FROM documents
""")
def duplicity_text(spark, sf_dir):
    return rounded(gf.duplicity(table(spark, sf_dir, "documents"), ["text"]))


@query("duplicity_rows", f"""
WITH {GAPS},
g AS (SELECT user_id, event_type, value, count(*) AS n FROM gaps GROUP BY ALL)
SELECT sum(n)::BIGINT AS "rows", sum(n - 1)::BIGINT AS duplicates,
       round(sum(n - 1)::DOUBLE / sum(n)::DOUBLE, 6) AS duplicity
FROM g
""")
def duplicity_rows(spark, sf_dir):
    return rounded(
        gf.duplicity(events_with_gaps(spark, sf_dir), ["user_id", "event_type", "value"])
    )


OUTLIERS = f"""
WITH {GAPS},
r AS (SELECT user_id::DOUBLE AS user_id, value FROM gaps WHERE value IS NOT NULL),
q AS (SELECT quantile_cont(user_id, 0.25) AS a1, quantile_cont(user_id, 0.75) AS a3,
             quantile_cont(value, 0.25) AS b1, quantile_cont(value, 0.75) AS b3 FROM r),
o AS (SELECT 'user_id' AS "column", a1 AS q1, a3 AS q3,
             (SELECT avg(CASE WHEN user_id < a1 - 1.5 * (a3 - a1) OR user_id > a3 + 1.5 * (a3 - a1)
                              THEN 1.0::DOUBLE ELSE 0.0 END) FROM r) AS outlier_rate FROM q
      UNION ALL
      SELECT 'value', b1, b3,
             (SELECT avg(CASE WHEN value < b1 - 1.5 * (b3 - b1) OR value > b3 + 1.5 * (b3 - b1)
                              THEN 1.0::DOUBLE ELSE 0.0 END) FROM r) FROM q)
"""


@query("outliers", OUTLIERS + """
SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3,
       round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper,
       round(outlier_rate, 6) AS outlier_rate
FROM o
""")
def outliers(spark, sf_dir):
    return rounded(gf.outlier_rates(events_with_gaps(spark, sf_dir), ["user_id", "value"]))


@query("outliers_overall", OUTLIERS + "SELECT round(avg(outlier_rate), 6) AS overall FROM o")
def outliers_overall(spark, sf_dir):
    return rounded(gf.outlier_score(events_with_gaps(spark, sf_dir), ["user_id", "value"]))


def _summary_row(c):
    return f"""
SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
       round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25,
       round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
       round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max
FROM lineitem"""


LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax",
]


@query("summary_statistics", " UNION ALL ".join(map(_summary_row, LINEITEM_NUMBERS)))
def summary_statistics(spark, sf_dir):
    return rounded(gf.summary_statistics(table(spark, sf_dir, "lineitem")))


@query("feature_types", """
WITH n AS (SELECT count(*) AS records_count FROM orders)
SELECT v.ordinal, v."column", v.kind, n.records_count, 6::BIGINT AS features_count
FROM n, (VALUES (1, 'o_orderkey', 'numeric'), (2, 'o_custkey', 'numeric'),
                (3, 'o_totalprice', 'numeric'), (4, 'o_orderstatus', 'categorical'),
                (5, 'o_orderpriority', 'categorical')) AS v(ordinal, "column", kind)
""")
def feature_types(spark, sf_dir):
    return gf.feature_types(table(spark, sf_dir, "orders"))


@query("class_candidates", """
WITH d AS (
  SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) AS n FROM orders
  UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice) FROM orders
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders)
SELECT "column", n AS n_distinct, n <= 30 AS is_class_candidate FROM d
""")
def class_candidates(spark, sf_dir):
    return gf.class_candidates(table(spark, sf_dir, "orders"))


@query("density", f"""
WITH {GAPS},
s AS (SELECT count(value)::DOUBLE AS n, min(value) AS lo, max(value) AS hi,
             0.5::DOUBLE * power(count(value)::DOUBLE, -0.2::DOUBLE) * stddev_samp(value) AS h FROM gaps),
g AS (SELECT n, h, i AS point, lo - 3 * h + i * ((hi - lo + 6 * h) / 199.0::DOUBLE) AS x
      FROM s, range(200) AS r(i)),
v AS (SELECT value, count(*) AS w FROM gaps WHERE value IS NOT NULL GROUP BY value)
SELECT 'value' AS "column", point::INTEGER AS point, round(x, 6) AS grid_x,
       round(sum(w * exp(-0.5 * power((x - value) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g, v GROUP BY point, x, n, h
""")
def density(spark, sf_dir):
    return rounded(gf.density(events_with_gaps(spark, sf_dir), ["value"]))


@query("duplicity_nested", """
WITH k AS (SELECT DISTINCT ts, value FROM events), n AS (SELECT count(*) AS rows FROM events)
SELECT rows, rows - (SELECT count(*) FROM k) AS duplicates,
       round((rows - (SELECT count(*) FROM k))::DOUBLE / rows, 6) AS duplicity FROM n
""")
def duplicity_nested(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.struct("ts", "value").alias("pair"))
    return rounded(gf.duplicity(events))

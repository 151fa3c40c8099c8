"""Sources, sinks and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

import gaugeframe as gf

from .registry import new_folder, query, rounded, table


@query("csv_missing_tokens", """
SELECT event_id, user_id, CASE WHEN value <= 60 THEN event_type END AS event_type,
       CASE WHEN value >= 2 THEN value END AS value
FROM events
""")
def csv_missing_tokens(spark, sf_dir):
    """Writes CSV with missing tokens in text and number columns and reads it back."""
    path = new_folder(spark)
    e = table(spark, sf_dir, "events")
    gf.write_table(
        e.select(
            "event_id",
            "user_id",
            F.when(F.col("value") > 60, "n/a").otherwise(F.col("event_type")).alias("event_type"),
            F.when(F.col("value") < 2, "NULL").otherwise(F.col("value").cast("string")).alias("value"),
        ),
        path,
        format="csv",
    )
    return gf.read_csv(spark, path)


@query("normalize_missing", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
       CASE WHEN value >= 1 THEN value END AS value
FROM events
""")
def normalize_missing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return gf.normalize_missing(
        e.select(
            "event_id",
            F.when(F.col("event_type") == "error", "<NA>").otherwise(F.col("event_type")).alias("event_type"),
            F.when(F.col("value") < 1, float("nan")).otherwise(F.col("value")).alias("value"),
        )
    )


@query("npz_rows", """
SELECT vec_id, label, len(embedding)::INTEGER AS n,
       round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total
FROM embeddings
""")
def npz_rows(spark, sf_dir):
    """Packs the embeddings into NumPy archives and reads those."""

    def pack(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            if len(batch):
                buffer = io.BytesIO()
                np.savez(
                    buffer,
                    vec_id=batch["vec_id"].to_numpy(),
                    label=batch["label"].to_numpy().reshape(-1, 1),
                    embedding=np.stack(batch["embedding"].to_list()).astype("float64"),
                )
                yield pd.DataFrame({"content": [buffer.getvalue()]})

    archives = table(spark, sf_dir, "embeddings").mapInPandas(pack, "content binary")
    rows = gf.decode_npz(archives, "vec_id bigint, label int, embedding array<double>")
    return rows.select(
        "vec_id",
        "label",
        F.size("embedding").alias("n"),
        (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4) + F.lit(0.0)).alias("total"),
    )


REPORT = """
WITH gaps AS (SELECT CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS price, *  FROM orders),
ec AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
k AS (SELECT min(n) AS k, max(n) AS hi, avg(n) AS mean, quantile_cont(n::DOUBLE, 0.5) AS median FROM ec),
e AS (SELECT sum(log2(n)) / sum(n)::DOUBLE AS risk, min(log2(n)) AS lo, max(log2(n)) AS hi,
             avg(log2(n)) AS mean, quantile_cont(log2(n), 0.5) AS median FROM ec),
t AS (SELECT o_orderpriority AS c, stddev_pop(rate) AS tsd
      FROM (SELECT o_orderpriority, n::DOUBLE / sum(n) OVER (PARTITION BY o_orderstatus) AS rate FROM ec)
      GROUP BY o_orderpriority),
r(dimension, metric, subject, key, value, text) AS (
  SELECT 'quality', 'overall_completeness', '', 'overall', avg((price IS NOT NULL)::INTEGER), NULL FROM gaps
  UNION ALL SELECT 'quality', 'overall_completeness', '', 'status', NULL, 'partial'
  UNION ALL SELECT 'quality', 'duplicity', '', 'rows', count(*), NULL FROM orders
  UNION ALL SELECT 'quality', 'duplicity', '', 'duplicates',
                   count(*) - count(DISTINCT (o_custkey, o_orderstatus)), NULL FROM orders
  UNION ALL SELECT 'quality', 'duplicity', '', 'duplicity',
                   (count(*) - count(DISTINCT (o_custkey, o_orderstatus)))::DOUBLE / count(*), NULL FROM orders
  UNION ALL SELECT 'privacy', 'k_anonymity', '', u.key, u.value, NULL
            FROM k, (VALUES ('k'), ('min'), ('max'), ('mean'), ('median')) AS n(key),
                 LATERAL (SELECT n.key AS key, CASE n.key WHEN 'max' THEN k.hi::DOUBLE WHEN 'mean' THEN k.mean
                          WHEN 'median' THEN trunc(k.median) ELSE k.k::DOUBLE END AS value) AS u
  UNION ALL SELECT 'privacy', 'entropy_risk', '', u.key, u.value, NULL
            FROM e, (VALUES ('entropy_risk'), ('min'), ('max'), ('mean'), ('median')) AS n(key),
                 LATERAL (SELECT n.key AS key, CASE n.key WHEN 'entropy_risk' THEN e.risk WHEN 'min' THEN e.lo
                          WHEN 'max' THEN e.hi WHEN 'mean' THEN e.mean ELSE e.median END AS value) AS u
  UNION ALL SELECT 'fairness', 'rate_deviation', c, 'tsd', tsd, NULL FROM t)
SELECT dimension, metric, subject, key, round(value::DOUBLE, 2) AS value, text::VARCHAR AS text FROM r
"""


def orders_report(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice"))
    )
    qis = ["o_orderstatus", "o_orderpriority"]
    return gf.readiness_report(
        orders,
        {
            "overall_completeness": {},
            "duplicity": {"columns": ["o_custkey", "o_orderstatus"]},
            "k_anonymity": {"quasi_identifiers": qis},
            "entropy_risk": {"quasi_identifiers": qis},
            "rate_deviation": {"target": "o_orderpriority", "sensitive": "o_orderstatus"},
        },
    )


@query("readiness_report", REPORT)
def readiness_report(spark, sf_dir):
    return orders_report(spark, sf_dir)


@query("readiness_report_written", REPORT)
def readiness_report_written(spark, sf_dir):
    path = new_folder(spark)
    report = orders_report(spark, sf_dir)
    gf.write_report(report, path)
    return rounded(spark.read.schema(report.schema).json(path), 2)


@query("csv_quoted", """
SELECT doc_id, nullif(source, '') AS source, md5(text) AS text_md5, length(text) AS n FROM documents
""")
def csv_quoted(spark, sf_dir):
    """Texts with quotes and line breaks, written by the rule of RFC 4180 without Spark's CSV writer."""
    path = new_folder(spark)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id"), quoted("source"), quoted("text"))
    # each partition is one file; the lower 33 bits number its rows
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    header = F.when(first, F.lit("doc_id,source,text\n")).otherwise("")
    table(spark, sf_dir, "documents").select(F.concat(header, line).alias("value")).write.text(path)
    back = gf.read_csv(spark, path, "doc_id bigint, source string, text string")
    return back.select("doc_id", "source", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"))

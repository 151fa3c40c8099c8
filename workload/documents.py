"""JSON documents: flattening, keys and FAIR checks.

The documents are written from the rows of the sample tables, one per row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

import gaugeframe as gf

from .registry import new_folder, query, rounded, table


def order_documents(spark, sf_dir):
    part = lambda name, code: F.struct(F.lit(name).alias("name"), F.col(code).alias("code"))
    return table(spark, sf_dir, "orders").select(
        F.to_json(
            F.struct(
                F.struct(
                    F.col("o_orderkey").alias("id"),
                    F.array(part("status", "o_orderstatus"), part("priority", "o_orderpriority")).alias("parts"),
                ).alias("order"),
                F.array(F.struct(F.col("o_totalprice").alias("total"))).alias("prices"),
                F.array("o_custkey").alias("customers"),
            )
        ).alias("doc")
    )


ORDER_SCHEMA = (
    "order struct<id: bigint, parts: array<struct<name: string, code: string>>>, "
    "prices array<struct<total: double>>, customers array<bigint>"
)


@query("json_rows", """
SELECT 'status' AS name, o_orderstatus AS code, NULL::DOUBLE AS total FROM orders
UNION ALL SELECT 'priority', o_orderpriority, NULL FROM orders
UNION ALL SELECT NULL, NULL, o_totalprice FROM orders
""")
def json_rows(spark, sf_dir):
    docs = order_documents(spark, sf_dir).select(F.from_json("doc", ORDER_SCHEMA).alias("d"))
    return gf.json_rows(docs.select("d.*"))


@query("json_keep_keys", """
SELECT o_custkey AS customer, o_totalprice AS total FROM orders
""")
def json_keep_keys(spark, sf_dir):
    docs = order_documents(spark, sf_dir).select(F.from_json("doc", ORDER_SCHEMA).alias("d"))
    kept = gf.keep_keys(docs.select("d.*"), ["prices", "customers", "absent"])
    return kept.select(
        F.col("customers")[0].alias("customer"), F.col("prices")[0]["total"].alias("total")
    )


@query("json_keys", """
SELECT event_id, 0 AS ordinal, 'k' AS key FROM events WHERE props LIKE '{"k":%'
""")
def json_keys(spark, sf_dir):
    return gf.json_keys(table(spark, sf_dir, "events").select("event_id", "props"), "props")


def dcat_documents(spark, sf_dir):
    """Catalogue entries of the documents; keys are not in alphabetical order."""
    english = F.col("lang") == "en"
    file = lambda kind: F.struct(
        F.concat(F.lit(kind), F.lit(" of "), "source").alias("title"),
        F.lit(kind).alias("format"),
        F.when(~english, F.concat(F.lit("https://files/"), F.col("doc_id"))).alias("downloadURL"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.to_json(
            F.struct(
                F.col("source").alias("title"),
                F.struct(F.lit("desk").alias("fn"), F.col("n_chars").alias("office_title")).alias("contactPoint"),
                F.array("lang", "source").alias("keyword"),
                F.array(file("txt"), file("csv")).alias("distribution"),
                F.lit('{"type": "Point"}').alias("spatial"),
                F.col("text").alias("description"),
                F.array(F.array("n_chars", "doc_id")).alias("extent"),
                F.when(english, F.lit("cc")).alias("license"),
            )
        ).alias("doc"),
    )


LEAVES = """
WITH leaves AS (
  SELECT doc_id, '0' AS ord, 'title' AS key, source AS value FROM documents
  UNION ALL SELECT doc_id, '1.0', 'contactPoint_fn', 'desk' FROM documents
  UNION ALL SELECT doc_id, '1.1', 'contactPoint_office_title', n_chars::VARCHAR FROM documents
  UNION ALL SELECT doc_id, '2.0', 'keyword_1', lang FROM documents
  UNION ALL SELECT doc_id, '2.1', 'keyword_2', source FROM documents
  UNION ALL SELECT doc_id, '3.0.0', 'distribution_1_title', 'txt of ' || source FROM documents
  UNION ALL SELECT doc_id, '3.0.1', 'distribution_1_format', 'txt' FROM documents
  UNION ALL SELECT doc_id, '3.0.2', 'distribution_1_downloadURL', 'https://files/' || doc_id
            FROM documents WHERE lang <> 'en'
  UNION ALL SELECT doc_id, '3.1.0', 'distribution_2_title', 'csv of ' || source FROM documents
  UNION ALL SELECT doc_id, '3.1.1', 'distribution_2_format', 'csv' FROM documents
  UNION ALL SELECT doc_id, '3.1.2', 'distribution_2_downloadURL', 'https://files/' || doc_id
            FROM documents WHERE lang <> 'en'
  UNION ALL SELECT doc_id, '4', 'spatial', '{"type": "Point"}' FROM documents
  UNION ALL SELECT doc_id, '5', 'description', text FROM documents
  UNION ALL SELECT doc_id, '6.0', 'extent_1', '[' || n_chars || ',' || doc_id || ']' FROM documents
  UNION ALL SELECT doc_id, '7', 'license', 'cc' FROM documents WHERE lang = 'en')
"""


@query("metadata_leaves", LEAVES + """
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INTEGER AS ord, key, value
FROM leaves
""")
def metadata_leaves(spark, sf_dir):
    return gf.flatten_documents(dcat_documents(spark, sf_dir))


DCAT = LEAVES + """,
slots(principle, field, wanted) AS (VALUES
  ('Findable', 'identifier', NULL), ('Findable', 'title', 'title'),
  ('Findable', 'description', 'description'), ('Findable', 'keyword', 'keyword_1'),
  ('Findable', 'theme', NULL), ('Findable', 'landingPage', NULL),
  ('Accessible', 'accessLevel', NULL), ('Accessible', 'downloadURL', 'distribution_1_downloadURL'),
  ('Accessible', 'mediaType', NULL), ('Accessible', 'accessURL', NULL),
  ('Accessible', 'issued', NULL), ('Accessible', 'modified', NULL),
  ('Interoperable', 'conformsTo', NULL), ('Interoperable', 'references', NULL),
  ('Interoperable', 'language', NULL), ('Interoperable', 'format', 'distribution_1_format'),
  ('Interoperable', 'spatial', 'spatial'), ('Interoperable', 'temporal', NULL),
  ('Reusable', 'license', 'license'), ('Reusable', 'rights', NULL), ('Reusable', 'publisher', NULL),
  ('Reusable', 'description', NULL), ('Reusable', 'format', 'distribution_2_format'),
  ('Reusable', 'programCode', NULL), ('Reusable', 'bureauCode', NULL),
  ('Reusable', 'contactPoint', NULL)),
checks AS (SELECT d.doc_id, s.principle, s.field, l.key AS matched_key, l.value,
                  l.key IS NOT NULL AS passed
           FROM documents AS d CROSS JOIN slots AS s
           LEFT JOIN leaves AS l ON l.doc_id = d.doc_id AND l.key = s.wanted)
"""
SCORES = """
SELECT doc_id, principle, passed, total - passed AS failed, total,
       round(passed * 100.0::DOUBLE / total, 6) AS pct
FROM (SELECT doc_id, coalesce(principle, 'Total') AS principle,
             count(*) FILTER (passed) AS passed, count(*) AS total
      FROM checks GROUP BY GROUPING SETS ((doc_id, principle), (doc_id)))
"""


@query("fair_dcat", DCAT + """
SELECT doc_id, principle, field, matched_key, value, passed FROM checks
""")
def fair_dcat(spark, sf_dir):
    return gf.dcat_checks(dcat_documents(spark, sf_dir))


@query("fair_dcat_scores", DCAT + SCORES)
def fair_dcat_scores(spark, sf_dir):
    return rounded(gf.dcat_scores(dcat_documents(spark, sf_dir)))


@query("fair_dcat_other", LEAVES + """
SELECT doc_id, key, value FROM leaves
WHERE key IN ('contactPoint_fn', 'contactPoint_office_title', 'keyword_2', 'distribution_1_title',
              'distribution_2_title', 'distribution_2_downloadURL', 'extent_1')
""")
def fair_dcat_other(spark, sf_dir):
    return gf.other_keys(dcat_documents(spark, sf_dir))


def datacite_documents(spark, sf_dir):
    """Customer records; BUILDING ones carry more fields, one of them without a value."""
    customer = table(spark, sf_dir, "customer")
    basic = F.struct(
        F.array(F.struct(F.col("c_name").alias("title"))).alias("titles"),
        F.col("c_mktsegment").alias("publisher"),
        F.struct(F.lit("x").alias("dates")).alias("nested"),
    )
    full = F.struct(
        F.array(F.struct(F.col("c_name").alias("title"))).alias("titles"),
        F.lit(None).cast("string").alias("language"),
        F.col("c_nationkey").alias("version"),
        F.array("c_custkey", "c_nationkey").alias("sizes"),
    )
    keep_nulls = {"ignoreNullFields": "false"}
    doc = F.when(F.col("c_mktsegment") == "BUILDING", F.to_json(full, keep_nulls)).otherwise(
        F.to_json(basic, keep_nulls)
    )
    return customer.select(F.col("c_custkey").alias("doc_id"), doc.alias("doc"))


DATACITE = """
WITH fields(principle, field) AS (VALUES
  ('Findable', 'identifiers'), ('Findable', 'creators'), ('Findable', 'titles'),
  ('Findable', 'publisher'), ('Findable', 'publicationYear'), ('Findable', 'subjects'),
  ('Findable', 'alternateIdentifiers'), ('Findable', 'relatedIdentifiers'),
  ('Findable', 'descriptions'), ('Findable', 'schemaVersion'), ('Accessible', 'contributors'),
  ('Interoperable', 'geoLocations'), ('Reusable', 'dates'), ('Reusable', 'language'),
  ('Reusable', 'sizes'), ('Reusable', 'formats'), ('Reusable', 'version'),
  ('Reusable', 'rightsList'), ('Reusable', 'fundingReferences')),
checks AS (SELECT c_custkey AS doc_id, principle, field,
                  CASE WHEN c_mktsegment = 'BUILDING'
                       THEN field IN ('titles', 'language', 'version', 'sizes')
                       ELSE field IN ('titles', 'publisher') END AS passed,
                  c_name, c_mktsegment, c_nationkey, c_custkey
           FROM customer CROSS JOIN fields)
"""


@query("fair_datacite", DATACITE + """
SELECT doc_id, principle, field, CASE WHEN passed THEN field END AS matched_key,
       CASE WHEN NOT passed THEN NULL
            WHEN field = 'titles' THEN '[{"title":"' || c_name || '"}]'
            WHEN field = 'publisher' THEN c_mktsegment
            WHEN field = 'sizes' THEN '[' || c_custkey || ',' || c_nationkey || ']'
            WHEN field = 'version' THEN c_nationkey::VARCHAR END AS value, passed
FROM checks
""")
def fair_datacite(spark, sf_dir):
    return gf.datacite_checks(datacite_documents(spark, sf_dir))


@query("fair_datacite_scores", DATACITE + SCORES)
def fair_datacite_scores(spark, sf_dir):
    return rounded(gf.datacite_scores(datacite_documents(spark, sf_dir)))


def deep_documents(spark, sf_dir, levels=60):
    """Every supplier as a document of many levels, every fifth of one."""
    inner = F.struct(F.col("s_suppkey").alias(f"l{levels}"), F.col("s_name").alias("name"))
    for level in range(levels - 1, 0, -1):
        inner = F.struct(inner.alias(f"l{level}"))
    flat = F.struct(F.col("s_suppkey").alias("id"), F.array("s_name", F.col("s_nationkey").cast("string")).alias("names"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("doc_id"),
        F.when(F.col("s_suppkey") % 5 == 0, F.to_json(flat)).otherwise(F.to_json(inner)).alias("doc"),
    )


@query("metadata_deep", """
WITH path AS (SELECT string_agg('l' || i, '_' ORDER BY i) AS p FROM range(1, 60) AS t(i))
SELECT s_suppkey AS doc_id, p || '_l60' AS key, s_suppkey::VARCHAR AS value FROM supplier, path WHERE s_suppkey % 5 <> 0
UNION ALL SELECT s_suppkey, p || '_name', s_name FROM supplier, path WHERE s_suppkey % 5 <> 0
UNION ALL SELECT s_suppkey, 'id', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey, 'names_1', s_name FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey, 'names_2', s_nationkey::VARCHAR FROM supplier WHERE s_suppkey % 5 = 0
""")
def metadata_deep(spark, sf_dir):
    return gf.flatten_documents(deep_documents(spark, sf_dir)).select("doc_id", "key", "value")


@query("json_files", """
SELECT o_orderkey AS id, o_custkey AS customer, NULL::VARCHAR AS priority FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1
""")
def json_files(spark, sf_dir):
    """Files that are a list and files that hold one, in one folder."""
    path = new_folder(spark)
    row = F.when(
        F.col("o_orderkey") % 2 == 0,
        F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))),
    ).otherwise(
        F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority")))
    )
    rows = F.concat(F.lit("["), F.concat_ws(",", F.array_sort(F.collect_list(row))), F.lit("]"))
    (
        table(spark, sf_dir, "orders")
        .groupBy((2 * F.floor(F.col("o_orderkey") / 10_000) + F.col("o_orderkey") % 2).alias("file"))
        .agg(rows.alias("rows"))
        .select(
            "file",
            F.when(F.col("file") % 2 == 0, F.col("rows"))
            .otherwise(F.concat(F.lit('{"kind": "orders", "inner": {"rows": '), "rows", F.lit("}}")))
            .alias("value"),
        )
        .write.partitionBy("file")
        .text(path)
    )
    return gf.read_json_rows(spark, f"{path}/*").select("id", "customer", "priority")


@query("fair_status", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ok' ELSE 'invalid' END AS status,
       CASE WHEN doc_id % 3 = 0 THEN 2::BIGINT END AS passed FROM documents
""")
def fair_status(spark, sf_dir):
    """A third are objects; the others are bare texts or lists, and have no score."""
    good = F.to_json(F.struct(F.col("source").alias("title"), F.col("lang").alias("language")))
    listed = F.to_json(F.array("source"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, good).when(F.col("doc_id") % 3 == 1, listed).otherwise(F.col("text")).alias("doc"),
    )
    scores = gf.fair_scores(gf.dcat_checks(docs)).filter("principle = 'Total'").select("doc_id", "passed")
    return gf.document_status(docs).join(scores, "doc_id", "left")


@query("fair_files", """
SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 10 = 0 THEN 'invalid' ELSE 'ok' END AS status,
       CASE WHEN s_suppkey % 10 <> 0 THEN 2::BIGINT END AS passed FROM supplier
""")
def fair_files(spark, sf_dir):
    """A file for each supplier; every tenth is broken off."""
    path = new_folder(spark)
    doc = F.to_json(F.struct(F.col("s_name").alias("title"), F.struct(F.col("s_nationkey").alias("format")).alias("file")))
    broken = F.when(F.col("s_suppkey") % 10 == 0, F.substring(doc, 1, 12)).otherwise(doc)
    (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").alias("file"), broken.alias("value"))
        .repartition(spark.sparkContext.defaultParallelism, "file")
        .write.partitionBy("file")
        .text(path)
    )
    read = new_folder(spark)
    gf.write_table(gf.read_documents(spark, path, recursive=True), read)
    docs = spark.read.parquet(read)
    docs = docs.withColumn("doc_id", F.regexp_extract("doc_id", r"file=(\d+)", 1).cast("bigint"))
    scores = gf.dcat_scores(docs).filter("principle = 'Total'").select("doc_id", "passed")
    return docs.select("doc_id", "status").join(scores, "doc_id", "left")

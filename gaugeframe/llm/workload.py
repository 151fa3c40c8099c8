"""Queries of this package on the sample tables, with SQL texts where SQL can tell them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    hyperminhash,
    invertible_sketch,
    kneser_ney,
    language_pieces,
    line_dedup,
    mixing,
    packing,
    personal_data,
    quality_rules,
    substring_dedup,
    token_alignment,
    vector_search,
    whitening,
)
from .storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, of: int) -> Column:
    """CRC-32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of


def word_tokenizer() -> str:
    """The vocabulary file of the public word tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query(
    "op1_mix_sources",
    r"""
    WITH rows AS (
      SELECT doc_id,
             CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
             CASE WHEN text IS NULL THEN 0
                  ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
             ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|'
                                 || coalesce(text, '')), 1, 15))::BIGINT AS place
      FROM documents),
    sources AS (
      SELECT src, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY src) - 1) % 3
               WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
      FROM rows GROUP BY src),
    running AS (
      SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS level,
             sum(2.0::DOUBLE * source_size) OVER w - 2.0::DOUBLE * source_size AS filled,
             sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, src
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             1.5::DOUBLE * sum(source_size) OVER () AS total
      FROM sources
      WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, src
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    unit AS (SELECT max((total - filled) / open) AS x FROM running
             WHERE (total - filled) / open <= level),
    targets AS (SELECT src, source_size, least(cap, weight * x) AS target FROM running, unit),
    budgets AS (
      SELECT src, nth, least(source_size::DOUBLE, target - (nth - 1) * source_size) AS budget,
             target >= nth * source_size AS whole
      FROM targets, (VALUES (1), (2)) AS r(nth)),
    places AS (SELECT src, place, sum(size) AS tokens FROM rows GROUP BY src, place),
    sums AS (
      SELECT src, place, tokens,
             sum(tokens) OVER (PARTITION BY src ORDER BY place
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until
      FROM places),
    taken AS (
      SELECT src, nth, place
      FROM sums JOIN budgets USING (src)
      WHERE whole OR (budget > 0 AND (until < budget OR (
            until - tokens < budget AND until - budget < budget - (until - tokens)))))
    SELECT doc_id, size, source_size, round(target, 6) AS target,
           size * (SELECT count(*) FROM taken t WHERE t.src = rows.src AND t.place = rows.place)
             AS taken
    FROM rows JOIN targets USING (src)
    """,
)
def op1_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = mixing.sized(docs)
    narrow = written(rows.select(F.col("doc.doc_id").alias("doc_id"), "src", "size", "place"))
    mixed = mixing.mixture(narrow, narrow=narrow)
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (F.col("size") * F.col("repeats")).alias("taken"),
    )


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows, _ = quality_rules.judged_ids(docs, labels)
    return rows.select(
        F.col("id").alias("doc_id"),
        *[F.col(f"q.{name}").alias(name) for name in (*quality_rules.COUNTS, "base_failed")],
        "kept",
    )


@query("op3_cost_packing")
def op3_cost_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.digest(packing.pack(docs, word_tokenizer()))


@query(
    "op4_hyperminhash",
    r"""
    WITH RECURSIVE texts AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    sets AS (
      SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
        END AS s
      FROM texts),
    shingles AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
    shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
      FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
      SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
      WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached(doc_id, other) AS (
      SELECT doc_id, doc_id FROM documents
      UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other),
    groups AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
    SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sets JOIN groups USING (doc_id)
    """,
)
def op4_hyperminhash(spark, sf_dir):
    found = hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


@query(
    "op5_fm_index",
    r"""
    WITH texts AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM texts),
    windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM starts),
    repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
    gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM windows JOIN repeated USING (h)),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM texts),
    kept AS (
      SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
      FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)
    """,
)
def op5_fm_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeated(docs).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_removed",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op6_invertible_sketch")
def op6_invertible_sketch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return invertible_sketch.fingerprints(docs).select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        "n_changed",
    )


@query(
    "op7_bloom_lines",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
      FROM documents),
    keyed AS (
      SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
      FROM lines),
    repeated AS (
      SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (
      SELECT k.doc_id, k.line, k.place, r.key IS NOT NULL AND k.doc_id <> r.keeper AS lost
      FROM keyed k LEFT JOIN repeated r USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), ''))
             AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op7_bloom_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = line_dedup.without_repeated_lines(docs)
    return rows.select(
        "doc.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("left", "\n"), 256).alias("kept_sha256"),
    )


@query("op8_kneser_ney")
def op8_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(remainder("doc_id", 7) != 2))
    return kneser_ney.score(docs, model).select(
        F.col("id").alias("doc_id"),
        (remainder("id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query("op9_language_pieces")
def op9_language_pieces(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_pieces.predict_language(
        docs,
        docs.where(remainder("doc_id", 4) != 2),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return found.select(
        F.col("id").alias("doc_id"),
        (remainder("id", 4) == 2).alias("held_out"),
        F.col("lang").alias("lang_pred"),
        "score",
    )


@query("op10_personal_data")
def op10_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = personal_data.find_personal_data(docs)
    base, extra = personal_data.BASE, personal_data.EXTRA
    return rows.select(
        "doc.doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(personal_data.listing(base), 256).alias("base_sha256"),
        personal_data.listing((*base, *extra)).alias("spans"),
    )


@query(
    "op11_block_search",
    """
    WITH vectors AS (
      SELECT vec_id, row_number() OVER () AS row,
             list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
    scored AS (
      SELECT q.vec_id AS query_id, q.row, v.vec_id,
             list_dot_product(q.x, v.x)::BIGINT AS score
      FROM vectors q JOIN vectors v ON q.vec_id % 50 = 0 AND q.row <> v.row),
    ranked AS (
      SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank,
             vec_id, score
      FROM scored)
    SELECT * FROM ranked WHERE rank <= 5
    """,
)
def op11_block_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vector_search.top_products(rows, F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


@query("op12_jacobi_davidson")
def op12_jacobi_davidson(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumnRenamed("id", "vec_id").withColumn(
        "deviation", F.col("deviation").cast("long")
    )


@query("op13_spill_alignment")
def op13_spill_alignment(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_alignment.align(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return found.withColumnRenamed("id", "doc_id")

"""Mixing sources to target weights by hash thresholds.

Every document has a place in [0, 2**60) that follows from its id and text. A source
that may spend a budget takes the documents below a threshold, so a smaller budget
takes a subset of a larger one. Thresholds come from histograms: tokens are summed by
source and hash bucket, the running sum tells in which bucket the budget ends, and only
the rows of that bucket are summed again by finer buckets, until it holds one place.
Nothing is sorted; a hot source is pre-aggregated to one row per bucket and task.

Beyond a budget of all its tokens a source repeats: the r-th copy of a document is
taken if its place is below the threshold of the r-th budget.

Defined cases: a null text has size 0; null is a source of its own and the last; rows
equal in id and text share a place and are taken together; an empty table gives an empty
table; other columns, whatever their names, pass through.
The table with one row per source passes through one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .words import word_count

HASH_BITS = 60
BUCKET_BITS = 10
WEIGHTS = (5.0, 2.0, 1.0)


def sized(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """Columns ``doc`` (the row), ``src`` (sortable source), ``size`` and ``place``."""
    text, source = docs[text_col], docs[source_col]
    name = F.concat_ws(
        "|",
        F.lit(seed),
        F.coalesce(docs[id_col].cast("string"), F.lit("")),
        F.coalesce(text, F.lit("")),
    )
    place = F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.select(
        F.struct("*").alias("doc"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("src"),
        word_count(text).alias("size"),
        place.alias("place"),
    )


def source_targets(
    rows: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    max_repeats: int = 2,
) -> DataFrame:
    """``src, source_size, target``: shares by weight, none above ``max_repeats`` sizes.

    Sources in order weigh ``weights``, repeating. With x the common target per unit of
    weight, a source gets ``min(weight * x, cap)``; in order of cap per weight the first
    source that x leaves below its cap tells x.
    """
    by_name, one = Window.orderBy("src"), Window.orderBy("level", "src")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    sources = (
        rows.groupBy("src")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(listed, (F.col("nth") % len(weights)).cast("int")))
        .withColumn("cap", F.col("source_size") * float(max_repeats))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * float(share))
        .withColumn("full", F.sum("cap").over(one) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(one.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("x", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn(
            "x", F.max(F.when(F.col("x") <= F.col("level"), F.col("x"))).over(Window.partitionBy())
        )
    )
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("x")), F.col("cap"))
    return sources.select("src", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``src, nth, threshold`` for ``budgets(src, nth, budget, whole)``: places below are taken.

    The tokens below a threshold are as near to the budget as whole documents allow;
    ``whole`` budgets take every document.
    """
    top = 1 << HASH_BITS
    state = written(
        budgets.select(
            "src",
            "nth",
            "budget",
            "whole",
            F.lit(0).cast("long").alias("low"),
            F.lit(0).cast("long").alias("below"),
            F.lit(0).cast("long").alias("at"),
            (F.col("whole") | (F.col("budget") <= 0)).alias("done"),
        )
    )
    for width in range(HASH_BITS - BUCKET_BITS, -1, -BUCKET_BITS):
        open_ = state.where(~F.col("done")).drop("at", "done", "whole")
        inside = open_ if width == HASH_BITS - BUCKET_BITS else None
        joined = rows.select("src", "place", "size").join(open_, "src")
        if inside is None:
            span = width + BUCKET_BITS
            joined = joined.where(F.shiftright("place", span) == F.shiftright("low", span))
        buckets = joined.groupBy(
            "src", "nth", "budget", "below", F.shiftright("place", width).alias("bucket")
        ).agg(
            F.sum("size").alias("tokens"),
            F.min("place").alias("first"),
            F.max("place").alias("last"),
        )
        order = Window.partitionBy("src", "nth").orderBy("bucket")
        found = (
            buckets.withColumn("until", F.col("below") + F.sum("tokens").over(order))
            .where(F.col("until") >= F.col("budget"))
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") == 1)
            .select(
                "src",
                "nth",
                F.col("first").alias("low1"),
                (F.col("until") - F.col("tokens")).alias("below1"),
                F.col("tokens").alias("at1"),
                (F.col("first") == F.col("last")).alias("done1"),
            )
        )
        state = written(
            state.join(found, ["src", "nth"], "left").select(
                "src",
                "nth",
                "budget",
                "whole",
                # an open budget without a bucket is above all that its source has
                F.when(F.col("done"), F.col("low"))
                .otherwise(F.coalesce("low1", F.lit(top)))
                .alias("low"),
                F.when(F.col("done"), F.col("below"))
                .otherwise(F.coalesce("below1", F.lit(0)))
                .alias("below"),
                F.when(F.col("done"), F.col("at"))
                .otherwise(F.coalesce("at1", F.lit(0)))
                .alias("at"),
                (F.col("done") | F.coalesce("done1", F.lit(True))).alias("done"),
            )
        )
        if state.where(~F.col("done")).isEmpty():
            break
    over = F.col("below") + F.col("at") - F.col("budget")
    nearer = over < F.col("budget") - F.col("below")
    return state.select(
        "src",
        "nth",
        F.when(F.col("whole"), F.lit(top))
        .when(F.col("budget") <= 0, F.lit(0).cast("long"))
        .when(nearer, F.col("low") + 1)
        .otherwise(F.col("low"))
        .alias("threshold"),
    )


def mixture(
    rows: DataFrame,
    *,
    narrow: DataFrame | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    max_repeats: int = 2,
) -> DataFrame:
    """``rows`` of :func:`sized` with ``source_size``, ``target`` and ``repeats``.

    ``narrow`` are the same rows without ``doc``, written once, for the histograms.
    """
    narrow = narrow if narrow is not None else written(rows.drop("doc"))
    targets = written(
        source_targets(narrow, weights=weights, share=share, max_repeats=max_repeats)
    )
    budgets = targets.select(
        "src",
        F.explode(F.sequence(F.lit(1), F.lit(max_repeats))).alias("nth"),
        "target",
        "source_size",
    ).select(
        "src",
        "nth",
        F.greatest(
            F.lit(0.0),
            F.least(
                F.col("source_size").cast("double"),
                F.col("target") - (F.col("nth") - 1) * F.col("source_size"),
            ),
        ).alias("budget"),
        (F.col("target") >= F.col("nth") * F.col("source_size")).alias("whole"),
    )
    limits = thresholds(narrow, budgets).groupBy("src").agg(
        F.array_sort(F.collect_list("threshold")).alias("limits")
    )
    table = written(targets.join(limits, "src"))
    repeats = F.size(F.filter("limits", lambda x: F.col("place") < x))
    return rows.join(table, "src").withColumn("repeats", repeats).drop("limits")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it."""
    names = ("id_col", "text_col", "source_col", "seed")
    rows = sized(docs, **{k: options.pop(k) for k in names if k in options})
    mixed = mixture(rows, **options)
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats")))
    return mixed.where("repeats > 0").select("doc", copies.alias("copy")).select("doc.*")

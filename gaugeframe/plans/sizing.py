"""Intermediate tables that are written once, and broadcast behind a measured size."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import ref

BROADCAST_BYTES = 64 * 1024 * 1024
FIXED_BYTES = 16


def own_folder(spark: SparkSession) -> str:
    """A temporary folder for a local session."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="run-")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder of the cluster.

    For small results that several jobs read; survives the loss of executors.
    A folder of its own is only made for a local session that names none; a cluster
    must name one that all executors share.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or own_folder(df.sparkSession))
    return df.checkpoint()


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measures the table: fixed width per column plus the length of its texts."""
    width = F.lit(FIXED_BYTES * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(ref(field.name)), F.lit(0))
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"] <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Settles ``df`` and adds a broadcast hint if its measured size allows.

    Without the hint the join shuffles and adaptive execution splits hot keys.
    """
    table = settled(df)
    return F.broadcast(table) if is_small(table, limit) else table


def few_combinations(
    rows: DataFrame, keys: Sequence[Sequence[str]], limit: int = BROADCAST_BYTES
) -> list[bool]:
    """For each list of columns: is a table with one row per combination small?

    Sketches all counts and the longest texts in one narrow pass. A table counts
    as small at half the limit, many times the error of the sketch away from it.
    """
    texts = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)}
    used = sorted({c for key in keys for c in key})
    longest = [
        (F.max(F.octet_length(ref(c))) if c in texts else F.lit(0)).alias(f"w{i}")
        for i, c in enumerate(used)
    ]
    found = [
        F.approx_count_distinct(F.struct(*[ref(c) for c in key])).alias(f"n{i}")
        for i, key in enumerate(keys)
    ]
    seen = rows.agg(*found, *longest).first()
    width = {c: FIXED_BYTES + (seen[f"w{i}"] or 0) for i, c in enumerate(used)}
    return [
        2 * seen[f"n{i}"] * (FIXED_BYTES * 2 + sum(width[c] for c in key)) <= limit
        for i, key in enumerate(keys)
    ]

"""Registration of queries and their SQL equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.plans.sizing import own_folder
from gaugeframe.sources.writers import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison: the order of a sum differs between engines."""
    doubles = {
        f.name: F.round(f.name, places) + F.lit(0.0)
        for f in df.schema.fields
        if isinstance(f.dataType, T.DoubleType)
    }
    return df.withColumns(doubles) if doubles else df


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for a written table, shared by the cluster where it names one."""
    base = shared_folder(spark) or own_folder(spark)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"

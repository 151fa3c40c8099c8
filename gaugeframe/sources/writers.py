"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "csv", "json", "orc")


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Writes a table, replacing what was at the path."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """Writes a readiness report as JSON lines, one measured value per line."""
    report.write.mode("overwrite").json(path)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for written intermediate tables, if any."""
    return spark.conf.get("spark.checkpoint.dir", None)

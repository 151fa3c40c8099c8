"""Vectors as rows of integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(rows: DataFrame, vector_col: str, scale: int, **others: Column) -> DataFrame:
    """``others`` and ``x``, the floors of ``scale`` times the components, of the usable rows:
    those whose vector is not null and has no null, NaN or infinite component.
    """
    inner = rows.select(
        *[value.alias(name) for name, value in others.items()],
        rows[vector_col].cast("array<double>").alias("v"),
    )
    usable = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return inner.where(F.col("v").isNotNull() & usable).select(
        *others, F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x")
    )


def integer_rows(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows, with zeros where a list is shorter."""
    out = np.zeros((len(lists), max(dims, 1)), np.int64)
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lists)), lengths)
    column = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, column] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def press(values: np.ndarray) -> bytes:
    """A matrix of integers as zstd bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, "<i8").tobytes())


def matrix(data: bytes, width: int) -> np.ndarray:
    found = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")
    return found.reshape(-1, max(width, 1))

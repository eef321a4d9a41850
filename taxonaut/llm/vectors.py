"""Vectors as rows: which take part, classes of equal vectors, and their arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: str = "embedding") -> Column:
    """True for vectors that are not null and hold no null or non-finite component."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def fixed_point(scale: int, offset: int = 0, vector: str = "embedding") -> Column:
    """Components as whole numbers floor(scale * x) + offset, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale) + F.lit(offset).cast("long"))


def usable(vector: str = "embedding") -> Column:
    """True for vectors that are not null, empty or zero and hold no null or non-finite component."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def doubles(vector: str = "embedding") -> Column:
    """Components in double precision, negative zeros as zeros."""
    return F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column, shorter ones padded with zeros, and their widths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    widths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    width = int(widths.max()) if len(widths) else 0
    if len(widths) and (widths == width).all():
        return flat.reshape(len(widths), width), widths
    out = np.zeros((len(widths), width))
    out[np.arange(width)[None] < widths[:, None]] = flat
    return out, widths


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, the same for equal rows wherever they stand."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if x.size else x


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """x with `width` columns: padded with zeros, or cut."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def equal_vectors(rows: DataFrame) -> DataFrame:
    """Of (id, v): one row for each different vector with h1, h2 (its identity), rep (smallest id), copies, v."""
    return rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")}).groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))

"""Vectors as whole numbers, as clustering and search use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers may reach this size: sums of products of 512 of them still fit a long.
LARGEST = 1 << 26


def integers(vectors: DataFrame, id: str, embedding: str, scale: int, width: int | None = None) -> DataFrame:
    """(id, v): each component x as floor(scale * x), of the vectors that have no null and no
    non-finite component, and ``width`` components where one is asked for. A vector with a whole number
    beyond ``LARGEST`` takes no part, as a square of it may not fit a long."""
    whole = lambda x: F.floor(F.lit(scale) * x.cast("double"))
    edge = F.lit(float(LARGEST) / scale)
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < edge)
    rows = vectors.select(F.col(id).alias("id"), F.col(embedding).alias("e")).where(F.col("e").isNotNull())
    if width is not None:
        rows = rows.where(F.size("e") == width)
    return rows.where(F.forall("e", sound)).select("id", F.transform("e", whole).alias("v"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of longs as one matrix; shorter lists are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    wide = int(sizes.max(initial=0)) if width is None else width
    if len(flat) == len(sizes) * wide:
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out

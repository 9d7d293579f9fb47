"""Chunks that lie near an earlier chunk of their collection, found without listing pairs.

Equal vectors are settled first, by equality. The others are put into the cells of a grid: two vectors within a
distance differ by no more than that in their products with any direction of length one, so that they lie in one cell or
in neighbouring ones, and no pair is lost. The directions are those in which a bounded sample of the
vectors spreads most; they decide the work, not the result. Cells with many vectors are cut into tiles
on both sides. A task compares a tile of chunks with a tile of possible earlier ones and puts out each
chunk that has one at most once.

A chunk is kept when no earlier chunk of its collection, kept or not, and no stored one lies within the distance.
Chunks without a vector are compared by text. Chunks without a collection are a collection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyquill.functions.embedding import hash64
from tallyquill.operators import store
from tallyquill.session import written

#: Directions of the grid, and rows they are fitted on: those whose vectors have the least hashes.
AXES = 2
SAMPLE = 4096
#: Rows of one side of a tile.
TILE_ROWS = 4096
#: Distances are compared at this precision.
DIGITS = 12
#: Pairs whose distances are computed directly at a time.
PAIRS = 100_000


def _axes(vectors: DataFrame) -> np.ndarray:
    """Unit vectors along which the sample spreads most; of an empty table none."""
    rows = vectors.orderBy(F.xxhash64("_vector")).limit(SAMPLE).select("_vector").toPandas()["_vector"]
    if not len(rows):
        return np.zeros((0, 0))
    points = np.stack(rows)
    _, _, turned = np.linalg.svd(points - points.mean(axis=0), full_matrices=False)
    return turned[:AXES]


def _place(axis: np.ndarray, width: float) -> Column:
    weights = F.array(*(F.lit(float(x)) for x in axis))
    product = F.aggregate(F.zip_with("_vector", weights, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    return F.floor(product / F.lit(width))


def _cells(rows: DataFrame, axes: np.ndarray, width: float, around: bool) -> DataFrame:
    """Rows with their cell, or with each cell around theirs."""
    places = [_place(axis, width) for axis in axes]
    named = [place.alias(f"_x{i}") for i, place in enumerate(places)]
    out = rows.select("*", *named)
    for i in range(len(places) if around else 0):
        out = out.withColumn(f"_x{i}", F.explode(F.sequence(F.col(f"_x{i}") - 1, F.col(f"_x{i}") + 1)))
    columns = [f"_x{i}" for i in range(len(places))]
    return out.withColumn("_cell", F.to_json(F.struct("collection", *columns))).drop(*columns)


def _near(targets: pd.DataFrame, earlier: pd.DataFrame, distance: float) -> np.ndarray:
    """Which targets have a row within the distance that comes before them."""
    found = np.zeros(len(targets), dtype=bool)
    if not len(targets) or not len(earlier):
        return found
    a, b = np.stack(targets["_vector"]), np.stack(earlier["_vector"])
    slack = 1e-9 * (1 + (a * a).sum(1).max() + (b * b).sum(1).max())
    first, own = earlier["_rank"].to_numpy(), targets["_rank"].to_numpy()
    height = max(1, PAIRS * 10 // len(b))
    for start in range(0, len(a), height):
        part = slice(start, start + height)
        about = (a[part] ** 2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a[part] @ b.T
        row, col = np.nonzero((about <= distance + slack) & (first[None] < own[part, None]))
        for begin in range(0, len(row), PAIRS):
            i, j = row[begin : begin + PAIRS] + start, col[begin : begin + PAIRS]
            exact = np.round(((a[i] - b[j]) ** 2).sum(1), DIGITS) <= distance
            found[i[exact]] = True
    return found


def dedup_near(
    chunks: DataFrame, order: Sequence[str], distance: float, stored: DataFrame | None = None, embedder=hash64
) -> DataFrame:
    """Chunks that are kept at a squared ``distance``. ``order`` names columns that tell every chunk apart and say
    which comes first; ``stored`` has columns collection, text and embedding, and comes before all."""
    order = list(order)
    rows = chunks.withColumn("_vector", embedder(F.col("text"))).withColumn("_same", F.coalesce(F.md5(F.to_json("_vector")), F.md5("text")))
    kept = store.first_copies(rows, ["collection", "_same"], order)
    before = None
    if stored is not None:
        before = stored.select("collection", "text", F.col("embedding").alias("_vector"))
        before = before.withColumn("_same", F.coalesce(F.md5(F.to_json("_vector")), F.md5("text")))
        before = before.select("collection", "_vector", "_same").dropDuplicates(["collection", "_same"])
        kept = store.add_missing(before, kept, ["collection", "_same"])
    kept, _ = written(kept, "kept")
    narrow = kept.where(F.col("_vector").isNotNull()).select("collection", "_vector", *order, F.lit(False).alias("_stored"))
    axes = _axes(narrow)
    if not len(axes):
        return kept.drop("_vector", "_same")
    width = math.sqrt(distance) * (1 + 1e-6) + 1e-6
    first = narrow
    if before is not None:
        known = before.where(F.col("_vector").isNotNull()).select("collection", "_vector", F.lit(True).alias("_stored"))
        first = narrow.unionByName(known, allowMissingColumns=True)
    targets, earlier = _cells(narrow, axes, width, False), _cells(first, axes, width, True)
    tiles = lambda n: F.ceil(F.col(n) / TILE_ROWS).cast("int")
    counts = targets.groupBy("_cell").agg(F.count("*").alias("_t")).join(earlier.groupBy("_cell").agg(F.count("*").alias("_e")), "_cell")
    sizes = counts.select("_cell", tiles("_t").alias("_ts"), tiles("_e").alias("_es"))
    own = lambda n: F.pmod(F.xxhash64("_vector"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["collection", "_vector", "_stored", *order]
    left = targets.join(sizes, "_cell").select("_cell", own("_ts").alias("_i"), each("_es").alias("_j"), F.lit(True).alias("_target"), *columns)
    right = earlier.join(sizes, "_cell").select("_cell", each("_ts").alias("_i"), own("_es").alias("_j"), F.lit(False).alias("_target"), *columns)
    schema = narrow.select("collection", *order).schema

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        ranked = tile.sort_values(order, kind="stable")
        fresh = (ranked[order] != ranked[order].shift()).any(axis=1)
        tile["_rank"] = fresh.cumsum()
        tile.loc[tile["_stored"], "_rank"] = -1
        targets = tile[tile["_target"]]
        return targets[_near(targets, tile[~tile["_target"]], distance)][["collection", *order]]

    dropped = left.unionByName(right).groupBy("_cell", "_i", "_j").applyInPandas(compare, schema)
    return store._without(kept, dropped, ["collection", *order]).drop("_vector", "_same")

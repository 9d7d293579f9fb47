"""Clusters around centroids, the nearest centroid being found by the threshold algorithm.

1. Vectors become whole numbers, so that every distance and every mean is exact.
2. Each dimension has the list of all centroids in the order of their value there. A vector is put
   into each list at its own value, and all lists are walked outward from there, one centroid at a
   time, the closer side first. A centroid met for the first time has its distance computed.
3. The next centroids of all lists form the frontier. The sum of the frontier's squared differences is
   a bound for every centroid not met yet: the walk stops when it is strictly greater than
   the best distance, so that a tie always goes to the smaller number.
4. A task hands on one sum for each centroid, whatever the number of its vectors. Only these few
   rows are shuffled, and only centroids come to the driver.

Defined results. Vectors that are null, have another number of components, or a null, non-finite or
too large one (``vectors.LARGEST``) take no part and have no row. Repeated rows are vectors of their own, and may
be two centroids; the first of them gets all ties. Vectors with equal hashes (equal ids)
start in the order of their components; rows without id start last. With fewer vectors
than centroids there are as many centroids as vectors. A table without vectors gives an empty result.
Columns besides id and embedding are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyquill.llm import vectors as whole
from tallyquill.session import written

K = 40
ROUNDS = 5
WIDTH = 64
SCALE = 256
SALT = 2
#: Vectors that walk together, and distances computed together.
BLOCK = 4096
PAIRS = 16_384
#: Beyond every difference of two components.
FAR = 4 * whole.LARGEST


class Lists:
    """The centroids, and for each dimension their numbers in the order of their value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids.T, axis=1, kind="stable")
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def places(self, points: np.ndarray) -> np.ndarray:
        """For each point and dimension the last place in the list with a value not above its own."""
        columns = [np.searchsorted(self.values[d], points[:, d], side="right") - 1 for d in range(points.shape[1])]
        return np.stack(columns, axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each point's nearest centroid, and how many distances
        had to be computed."""
        found = np.zeros(len(points), dtype=np.int64)
        distance = np.zeros(len(points), dtype=np.int64)
        computed = 0
        for begin in range(0, len(points), BLOCK):
            part = slice(begin, begin + BLOCK)
            found[part], distance[part], n = self._walk(points[part])
            computed += n
        return found, distance, computed

    def _walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        k, width = self.centroids.shape
        far = np.iinfo(np.int64).max
        known = np.full((len(points), k), far, dtype=np.int64)
        line = np.arange(len(points))
        own = points
        left = self.places(points)
        right = left + 1
        dimension = np.arange(width)
        for _ in range(k):
            below = np.where(left >= 0, own - self.values[dimension, np.maximum(left, 0)], FAR)
            above = np.where(right < k, self.values[dimension, np.minimum(right, k - 1)] - own, FAR)
            frontier = np.minimum(below, above)
            going = (frontier * frontier).sum(axis=1) <= known[line].min(axis=1)
            if not going.all():
                line, own, left, right = line[going], own[going], left[going], right[going]
                below, above = below[going], above[going]
            if not len(line):
                break
            down = below <= above
            met = self.order[dimension, np.where(down, left, right)]
            fresh = np.zeros((len(line), k), dtype=bool)
            fresh[np.arange(len(line))[:, None], met] = True
            fresh &= known[line] == far
            row, number = np.nonzero(fresh)
            for begin in range(0, len(row), PAIRS):
                some, those = row[begin : begin + PAIRS], number[begin : begin + PAIRS]
                apart = own[some] - self.centroids[those]
                known[line[some], those] = np.einsum("ij,ij->i", apart, apart)
            left = left - down
            right = right + ~down
        found = known.argmin(axis=1)
        return found, known[np.arange(len(points)), found], int((known < far).sum())


def _summed(lists: Lists) -> Callable:
    """One row per centroid and task: how many vectors are nearest to it, and their sum."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = lists.centroids.shape
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for batch in batches:
            points = whole.matrix(batch.column("v"), width)
            found, _, _ = lists.nearest(points)
            count += np.bincount(found, minlength=k)
            np.add.at(total, found, points)
        some = np.flatnonzero(count)
        listed = pa.ListArray.from_arrays(
            pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(total[some].reshape(-1))
        )
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), listed], ["cluster", "n", "sums"])

    return sums


def _assigned(lists: Lists) -> Callable:
    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, distance, _ = lists.nearest(whole.matrix(batch.column("v"), lists.centroids.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"]
            )

    return assign


def _moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' mean, rounded down; a centroid without vectors stays."""
    partial = points.mapInArrow(_summed(Lists(centroids)), "cluster int, n long, sums array<long>")
    total = F.sum(F.col("sum").cast("decimal(38,0)")).cast("decimal(38,0)")
    rows = (
        partial.select("cluster", "n", F.posexplode("sums").alias("place", "sum"))
        .groupBy("cluster", "place")
        .agg(F.sum("n").alias("n"), total.alias("total"))
        .collect()  # one row per centroid and dimension
    )
    moved = centroids.copy()
    for row in rows:
        moved[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return moved


def starts(points: DataFrame, k: int, salt: int) -> np.ndarray:
    """The vectors whose salted ids have the least hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = points.orderBy(hashed.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([row["v"] for row in rows], dtype=np.int64)


def cluster(
    vectors: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    id: str = "vec_id",
    embedding: str = "embedding",
    width: int = WIDTH,
    scale: int = SCALE,
    salt: int = SALT,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each vector after ``rounds`` moves of the centroids, and the final
    centroids in units of 1 / ``scale``."""
    points, _ = written(whole.integers(vectors, id, embedding, scale, width), "points")
    kind = points.schema["id"].dataType.simpleString()
    centroids = starts(points, k, salt)
    if not len(centroids):
        return points.sparkSession.createDataFrame([], f"`{id}` {kind}, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = _moved(points, centroids)
    placed = points.mapInArrow(_assigned(Lists(centroids)), f"id {kind}, cluster int, distance long")
    return placed.withColumnRenamed("id", id), centroids


def digests(vectors: DataFrame, id: str = "vec_id", **options: object) -> DataFrame:
    """``cluster`` with the sums of distances over the cluster and over all, and the centroid's digest."""
    placed, centroids = cluster(vectors, id=id, **options)
    placed, _ = written(placed, "clusters")
    spark = placed.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {row["cluster"]: int(row["total"]) for row in placed.groupBy("cluster").agg(total.alias("total")).collect()}
    lines = [",".join(map(str, line)) for line in centroids.tolist()]
    each = spark.createDataFrame(
        [
            (number, sums[number], sum(sums.values()), hashlib.sha256(line.encode()).hexdigest())
            for number, line in enumerate(lines)
            if number in sums
        ],
        "of int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # One row per centroid.
    return placed.join(F.broadcast(each), placed["cluster"] == F.col("of")).drop("of")

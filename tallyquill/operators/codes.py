"""Approximate search on compressed codes: a rotation, product codes of 8 bits, an exact last step.

1. A seeded random rotation spreads what the dimensions hold evenly. The rotated vector is cut into
   short parts, and each part has up to 256 centres; a vector's code is the number of the nearest centre
   per part, one byte each. Codes are a column of the stored table, next to two numbers that say what
   the code leaves out: its part of the squared distance, and its product with the way to the mean of all rows.
2. A search scans ids, codes and these numbers only. A query's table of products with all centres is made where it is used, so
   the distance to a coded vector is a sum of looked-up numbers. What the code leaves out is known
   as far as the mean; it is used where a query lies nearer to the mean than to the row. A
   task keeps a short list per query.
3. Full vectors are read for the short lists alone, and ranked by their exact distances.

Centres are fitted on at most ``SAMPLE`` rows, those whose ids have the least hashes; every row
is coded, however many there are. ``recall`` measures a result against the exact search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyquill.operators import nearest as exact
from tallyquill.session import written

#: Rows the centres are fitted on, and how often they move.
SAMPLE = 4096
ROUNDS = 8
#: Centres per part: one byte.
CENTRES = 256
#: Dimensions of one part. With two, codes are half as long, and recall on the given tables falls from 1.0 to 0.93.
PART = 1
#: Rows of the short list for each wanted row.
SHORT = 2


@dataclass
class Codes:
    """Rotation (width x padded width), centres (parts x centres x dimensions) and mean, rotated."""

    rotation: np.ndarray
    centres: np.ndarray
    mean: np.ndarray

    def _parts(self, points: np.ndarray) -> np.ndarray:
        parts, _, size = self.centres.shape
        return (points @ self.rotation).reshape(len(points), parts, size)

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes; squared lengths of code and rest; twice the product of the rest with the way from the mean."""
        turned = self._parts(points)
        lines = np.empty(turned.shape[:2], dtype=np.uint8)
        coded = np.empty_like(turned)
        for p, centres in enumerate(self.centres):
            lines[:, p] = _apart(turned[:, p], centres).argmin(axis=1)
            coded[:, p] = centres[lines[:, p]]
        coded = coded.reshape(len(points), -1)
        rest = turned.reshape(len(points), -1) - coded
        return lines, (coded * coded).sum(axis=1) + (rest * rest).sum(axis=1), 2 * ((coded - self.mean) * rest).sum(axis=1)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minus twice the products of each query's parts with all centres (parts x queries x centres), and squared
        distances of the queries from the origin and the mean."""
        turned = self._parts(queries)
        return self.products(turned), *self.lengths(turned)

    def products(self, turned: np.ndarray) -> np.ndarray:
        """Of rotated queries. They take a few hundred times the room of the queries."""
        return np.stack([-2 * turned[:, p] @ centres.T for p, centres in enumerate(self.centres)])

    def lengths(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = turned.reshape(len(turned), -1)
        return (flat * flat).sum(axis=1), ((flat - self.mean) ** 2).sum(axis=1)


def _apart(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)


def fit(vectors: DataFrame, vid: str = "id", embedding: str = "embedding", seed: int = 0) -> Codes | None:
    """Codes for the vectors of a table; None if it has none."""
    rows = vectors.where(F.col(embedding).isNotNull()).select(vid, F.col(embedding).cast("array<double>").alias("e"))
    sample = rows.orderBy(F.xxhash64(vid), vid).limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return None
    points = exact._matrix(sample.column("e"))
    width = points.shape[1]
    padded = -(-width // PART) * PART
    pick = np.random.default_rng(seed)
    rotation = np.linalg.qr(pick.normal(size=(padded, padded)))[0][:width]
    turned = (points @ rotation).reshape(len(points), -1, PART)
    centres = np.stack([_moved(turned[:, p], pick) for p in range(turned.shape[1])])
    return Codes(rotation, centres, turned.reshape(len(points), -1).mean(axis=0))


def _moved(points: np.ndarray, pick: np.random.Generator) -> np.ndarray:
    """Centres of one part; with fewer points than centres some stand twice."""
    count = min(CENTRES, len(points))
    centres = points[np.resize(pick.permutation(len(points))[:count], CENTRES)].copy()
    for _ in range(ROUNDS):
        home = _apart(points, centres).argmin(axis=1)
        sizes = np.bincount(home, minlength=CENTRES)
        for d in range(points.shape[1]):
            sums = np.bincount(home, weights=points[:, d], minlength=CENTRES)
            centres[:, d] = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres[:, d])
    return centres


ADDED = T.StructType().add("code", "binary").add("code_length", "double").add("code_lean", "double")


def encode(vectors: DataFrame, codes: Codes, embedding: str = "embedding") -> DataFrame:
    """Adds the columns ``ADDED`` of each vector; a row without a vector has none."""
    schema = T.StructType([*vectors.schema.fields, *ADDED.fields])

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, exact.ROWS):
                batch = whole.slice(start, exact.ROWS)
                valid = pc.is_valid(batch.column(embedding))
                if valid.true_count:
                    lines, length, lean = codes.encode(exact._matrix(batch.column(embedding).filter(valid)))
                else:
                    lines, length, lean = [], [], []
                # The place of each row among those with a vector, or none.
                place = pc.if_else(valid, pc.subtract(pc.cumulative_sum(valid.cast("int64")), 1), None)
                columns = [pa.array([line.tobytes() for line in lines], pa.binary()), *(pa.array(x, pa.float64()) for x in (length, lean))]
                taken = [column.take(place) for column in columns]
                yield pa.RecordBatch.from_arrays([*batch.columns, *taken], names=[*batch.schema.names, *ADDED.names])

    return vectors.mapInArrow(coded, schema)


class _Short(exact._Best):
    """The shortest lists by coded distance. Tables are made for a block of queries at a time."""

    def __init__(self, codes: Codes, turned: np.ndarray, k: int):
        super().__init__(np.zeros((len(turned), 0)), k, "l2sq")
        self.codes, self.turned = codes, turned
        self.lengths, self.from_mean = codes.lengths(turned)
        self.height = max(1, exact.BLOCK_ELEMENTS // max(1, codes.centres[:, :, 0].size))

    def add_codes(self, ids: np.ndarray, lines: np.ndarray, length: np.ndarray, lean: np.ndarray) -> None:
        height = min(self.height, max(1, exact.BLOCK_ELEMENTS // max(1, len(ids))))
        for start in range(0, len(self.turned), height):
            part = slice(start, start + height)
            block = self.lengths[part, None] + length[None]
            for table, column in zip(self.codes.products(self.turned[part]), lines.T, strict=True):
                block += table[:, column]
            block += np.where(self.from_mean[part, None] < block, lean[None], 0)
            limit = self.bound[start : start + height]
            if len(ids) > self.k:
                limit = np.minimum(limit, np.partition(block, self.k - 1, axis=1)[:, self.k - 1])
            row, col = np.nonzero(block <= limit[:, None])
            self.rows = np.concatenate([self.rows, row + start])
            self.far = np.concatenate([self.far, block[row, col]])
            self.ids = np.concatenate([self.ids, ids[col]])
            if len(self.rows) > exact.BLOCK_ELEMENTS:
                self._trim()
        self._trim()


def _scanner(sent: Broadcast, k: int, schema: pa.Schema) -> Callable:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes, turned = sent.value
        best = _Short(codes, turned, k)
        for whole in batches:
            for start in range(0, whole.num_rows, exact.ROWS):
                batch = whole.slice(start, exact.ROWS)
                batch = batch.filter(pc.is_valid(batch.column(1)))
                if batch.num_rows:
                    lines = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                    ids = np.array(batch.column(0).to_pylist(), dtype=object)
                    best.add_codes(ids, lines, batch.column(2).to_numpy(), batch.column(3).to_numpy())
        asked = names.take(pa.array(best.rows))
        columns = [asked, pa.array(best.ids.tolist(), schema.field(1).type), pa.array(best.far, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return scan


def short_lists(
    queries: DataFrame, coded: DataFrame, codes: Codes, size: int, qid: str = "qid", vid: str = "id", embedding: str = "embedding"
) -> DataFrame:
    """(qid, id, distance, rank): the ``size`` nearest coded rows per query, by ids and codes alone."""
    schema = exact._result_schema(queries, coded, qid, vid)
    out = to_arrow_schema(schema)
    spark = coded.sparkSession
    found = spark.createDataFrame([], schema)
    for group in exact._groups(queries.select(qid, embedding), embedding):
        names = group.column(0).combine_chunks().cast(out.field(0).type)
        sent = spark.sparkContext.broadcast((names, codes, codes._parts(exact._matrix(group.column(1)))))
        found = found.unionAll(coded.select(vid, *ADDED.names).mapInArrow(_scanner(sent, size, out), schema))
    return exact._ranked(found, qid, vid, size)


def nearest_coded(
    queries: DataFrame, coded: DataFrame, codes: Codes | None, k: int = exact.TOP_K, short: int = SHORT, qid: str = "qid",
    vid: str = "id", embedding: str = "embedding",
) -> DataFrame:
    """Approximate top-k by squared distance as rows (qid, id, distance, rank): short lists of
    ``short`` x ``k`` rows, whose exact distances decide. ``coded`` should be a stored table, as it is read twice."""
    schema = exact._result_schema(queries, coded, qid, vid)
    if codes is None:
        return coded.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType(), False)]))
    listed, _ = written(short_lists(queries, coded, codes, short * k, qid, vid, embedding).select(qid, vid), "short")
    wanted = listed.select(F.col(vid).alias("_id")).distinct()
    full = coded.select(vid, embedding).join(wanted, F.col(vid) == F.col("_id"), "left_semi")
    asked = queries.select(F.col(qid).alias("_qid"), F.col(embedding).alias("_asked"))
    pairs = listed.join(full, vid).join(asked, F.col(qid) == F.col("_qid"))
    apart = F.aggregate(F.zip_with(embedding, "_asked", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)
    return exact._ranked(pairs.select(qid, vid, F.round(apart, exact.COMPARE_DIGITS).alias("distance")), qid, vid, k)


def recall(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = exact.TOP_K, qid: str = "qid", vid: str = "id") -> DataFrame:
    """One row: queries, wanted (true nearest rows), hits (those of them that were found), recall."""
    true = exact.nearest(queries, vectors, k, qid=qid, vid=vid).select(qid, vid)
    hits = true.join(found.select(qid, vid).withColumn("_hit", F.lit(1)), [qid, vid], "left")
    return hits.agg(
        F.countDistinct(qid).alias("queries"), F.count("*").alias("wanted"), F.count("_hit").alias("hits")
    ).withColumn("recall", F.col("hits") / F.col("wanted"))

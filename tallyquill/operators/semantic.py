"""Chunks made of similar pieces of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyquill.functions.embedding import BUCKETS, hash64
from tallyquill.session import checkpointed

# Number of clusters, and the mark that ends a piece.
CLUSTERS = 3
PIECE_END = "."
# Elements of the vectors that one task of the fit over all documents holds, at most.
PART_ELEMENTS = 32_000_000


def piece_texts(text: Column) -> Column:
    """All pieces between full stops, page by page; empty pieces are kept."""
    return F.flatten(F.transform(F.split(text, "\f"), lambda page: F.split(page, "[.]")))


def cluster(points: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Lloyd's algorithm from the first point and the points farthest from those chosen;
    labels are numbered by first use."""
    centers = points[:1].copy()
    while len(centers) < min(k, len(points)):
        nearest = _squares(points, centers).min(1)
        centers = np.vstack([centers, points[int(nearest.argmax())]])
    labels = np.zeros(len(points), dtype=int)
    for attempt in range(rounds):
        found = _squares(points, centers).argmin(1)
        if attempt and (found == labels).all():
            break
        labels = found
        for label in np.unique(labels):
            centers[label] = points[labels == label].mean(0)
    _, first = np.unique(labels, return_index=True)
    order = np.zeros(k, dtype=int)
    order[labels[np.sort(first)]] = np.arange(len(first))
    return order[labels]


def _squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, up to the same amount for each point, cut to equal halves."""
    return np.round((centers * centers).sum(1) - 2 * (points @ centers.T) + (points * points).sum(1)[:, None], 9)


def _with_zeros(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of any width as a matrix; a piece without a vector gets zeros."""
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy()
    width = len(values) // max(1, int(present.sum()))
    matrix = np.zeros((len(vectors), max(1, width)))
    if width:
        matrix[present] = values.reshape(-1, width)
    return matrix


def chunk_semantic(docs: DataFrame, k: int = CLUSTERS, embed=hash64) -> DataFrame:
    """Cluster the pieces of each document on its own. The unit of work is one document,
    so no document meets another and nothing is shuffled."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("page_num", T.IntegerType()),
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("chunk_name", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )
    listed = docs.select("doc_id", piece_texts(F.col("text")).alias("pieces")).where("pieces IS NOT NULL")
    vectors = listed.withColumn("vectors", F.transform("pieces", embed))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            matrix = _with_zeros(batch.column(2).flatten())
            ids, texts = batch.column(0).to_pylist(), batch.column(1).flatten().to_pylist()
            rows = []
            for doc_id, start, end in zip(ids, ends[:-1], ends[1:]):
                labels = cluster(matrix[start:end], k)
                for label in range(labels.max() + 1):
                    members = "\n".join(texts[start + i] for i in np.flatnonzero(labels == label))
                    rows.append((doc_id, None, label + 1, f"cluster_{label + 1}", members))
            columns = [list(column) for column in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(columns, out)], schema=out
            )

    out = to_arrow_schema(schema)
    return vectors.mapInArrow(group, schema)


def _dealt(docs: DataFrame, pieces: DataFrame, most: int) -> DataFrame:
    """Pieces in parts of at most ``most``. Where each task's documents have no more they stay where they are, as
    the first centres depend on that; else all are dealt anew, also those of one long document."""
    counted = docs.select(F.spark_partition_id().alias("part"), F.size(piece_texts(F.col("text"))).cast("bigint").alias("pieces"))
    sizes = counted.where("pieces > 0").groupBy("part").agg(F.sum("pieces").alias("pieces"))
    largest, total = sizes.agg(F.max("pieces"), F.sum("pieces")).first()
    if (largest or 0) <= most:
        return pieces
    return pieces.repartition(-(-2 * total // most))


def chunk_semantic_corpus(
    docs: DataFrame, k: int = CLUSTERS, seed: int = 0, embed=hash64, width: int = BUCKETS
) -> DataFrame:
    """Cluster the pieces of all documents together with one distributed fit, so that
    cluster numbers mean the same in every document. ``width`` is that of the embedder. The vectors that
    one task holds have a bound, whatever the files' splits are."""
    cut = docs.select("doc_id", F.posexplode(piece_texts(F.col("text"))).alias("position", "piece"))
    pieces = _dealt(docs, cut, max(1, PART_ELEMENTS // width))
    zeros = F.array_repeat(F.lit(0.0), width)
    embedded = pieces.withColumn("vector", F.coalesce(embed(F.col("piece")), zeros))
    points = checkpointed(embedded).withColumn("features", array_to_vector("vector")).drop("vector")
    if points.isEmpty():  # nothing to fit: no rows, in the columns below
        numbered = points.withColumn("prediction", F.lit(0))
    else:
        numbered = KMeans(k=k, seed=seed, maxIter=20).fit(points.select("features")).transform(points)
    members = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda member: member["piece"]
    )
    return (
        numbered.groupBy("doc_id", "prediction")
        .agg(F.array_join(members, "\n").alias("text"))
        .select(
            "doc_id",
            F.lit(None).cast("int").alias("page_num"),
            (F.col("prediction") + 1).alias("chunk_index"),
            F.concat(F.lit("cluster_"), (F.col("prediction") + 1).cast("string")).alias("chunk_name"),
            "text",
        )
    )

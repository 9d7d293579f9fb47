"""Exact top-k by inner product with MaxScore over postings of vector components.

1. Vectors become whole numbers. Each dimension and sign is a term: the posting of a term lists the
   vectors whose component there has that sign, with its size. A query's term adds to the score of
   the vectors in its posting, and takes from those of the other sign.
2. Stored vectors are never shuffled: each task cuts its rows into shards of bounded size, builds their postings
   and asks them all queries of a group. Queries come in groups of bounded size, one
   after the other; a group is sent to the tasks once.
3. In a shard the query's terms are sorted by their score bound: its component times the largest in the posting.
   Terms at the end whose bounds together stay below the k-th best score so far cannot
   lift a vector into the result by themselves: they are non-essential. The postings of all others are
   traversed, and only vectors found there that can still reach the score are probed, the
   terms that can only take first, then the rest in the order of their bounds, as long as they can reach it.
4. The k-th best score is carried from shard to shard of a task. A task hands on k rows per query, and
   these are merged in two steps, first in parts, then per query.

Defined results. Vectors that are null, hold a null or non-finite component or one that is too large
(``vectors.LARGEST``) neither ask nor are found. A shorter vector is in no posting of the
dimensions it lacks; one without components has score 0 with all. Ties go to the smaller id, rows without id come
last. A query's own row is left out once: another row with its id is found like any other. Rows
without id ask nothing. An empty side gives an empty result. Columns besides id and embedding are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyquill.llm import vectors as whole
from tallyquill.session import written

K = 10
SCALE = 1024
#: Components of the vectors in one shard, and of the queries in one group.
SHARD = 1 << 20
GROUP = 1 << 22
#: Terms that are probed before the rest is looked at again.
PROBES = 8
#: Rows whose scores are computed without a bound to begin with.
FIRST = 64
#: Parts in which the results of a query are merged first.
PARTS = 32
#: Ids of rows without one sort behind all others.
_LAST = np.iinfo(np.int64).max


class Shard:
    """Postings of some vectors: rows and values by dimension and sign."""

    def __init__(self, ids: np.ndarray, named: np.ndarray, points: np.ndarray):
        self.ids, self.named = ids, named
        self.columns = np.ascontiguousarray(points.T)
        self.top = points.max(axis=0, initial=0)
        self.bottom = points.min(axis=0, initial=0)
        self.postings: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    def posting(self, dimension: int, positive: bool) -> tuple[np.ndarray, np.ndarray]:
        key = (dimension, positive)
        if key not in self.postings:
            column = self.columns[dimension]
            rows = np.flatnonzero(column > 0 if positive else column < 0)
            self.postings[key] = rows, column[rows]
        return self.postings[key]

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return query @ self.columns[:, rows]

    def search(self, query: np.ndarray, best: Best) -> None:
        terms = np.flatnonzero(query)
        bounds = np.where(query > 0, query * self.top, query * self.bottom)[terms]
        order = np.argsort(-bounds, kind="stable")
        terms, bounds = terms[order].tolist(), bounds[order]
        #: What the terms from a place on can add at most.
        rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])
        size = len(self.ids)
        begin = 0
        if best.least is None:
            begin = min(size, max(FIRST, best.k))
            rows = np.arange(begin)
            best.add(self, rows, self.scores(query, rows))
        if begin == size:
            return
        limit = best.least
        below = np.flatnonzero(rest < limit) if limit is not None else []
        if len(below):
            essential = int(below[0])
            partial = np.zeros(size, dtype=np.int64)
            for dimension in terms[:essential]:
                rows, values = self.posting(dimension, query[dimension] > 0)
                partial[rows] += query[dimension] * values
            rows = np.flatnonzero(partial + rest[essential] >= limit)
            rows = rows[rows >= begin]
            partial = partial[rows]
            # What the essential terms take, then all of the others.
            probes = [(d, True, essential) for d in terms[:essential]]
            probes += [(d, False, place + 1) for place, d in enumerate(terms[essential:], essential)]
        else:  # even a vector in none of the postings may be among the best
            rows, partial = np.arange(begin, size), np.zeros(size - begin, dtype=np.int64)
            probes = [(d, False, place + 1) for place, d in enumerate(terms)]
        for at in range(0, len(probes), PROBES):
            if not len(rows):
                return
            for dimension, takes, _ in probes[at : at + PROBES]:
                added = query[dimension] * self.columns[dimension][rows]
                partial += np.minimum(added, 0) if takes else added
            if limit is not None:
                going = partial + rest[probes[min(at + PROBES, len(probes)) - 1][2]] >= limit
                rows, partial = rows[going], partial[going]
        best.add(self, rows, partial)


class Best:
    """The ``k`` best (score, id) of one query so far; rows without id last among equals."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.empty(0, dtype=np.int64)
        self.id = np.empty(0, dtype=np.int64)
        self.named = np.empty(0, dtype=bool)

    @property
    def least(self) -> int | None:
        return int(self.score[-1]) if len(self.score) == self.k else None

    def add(self, shard: Shard, rows: np.ndarray, score: np.ndarray) -> None:
        if not len(rows):
            return
        score = np.concatenate([self.score, score])
        id = np.concatenate([self.id, shard.ids[rows]])
        named = np.concatenate([self.named, shard.named[rows]])
        if len(score) > 4 * self.k:  # a crowd: only what reaches the k-th score is sorted
            some = np.flatnonzero(score >= np.partition(score, len(score) - self.k)[len(score) - self.k])
            score, id, named = score[some], id[some], named[some]
        order = np.lexsort((id, ~named, -score))[: self.k]
        self.score, self.id, self.named = score[order], id[order], named[order]


def _searcher(group: Broadcast, k: int) -> Callable:
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, queries = group.value
        best = [Best(k) for _ in number]
        held: list[pa.RecordBatch] = []
        size = 0

        def ask() -> None:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            points = whole.matrix(rows.column("v"))
            wide = max(points.shape[1], queries.shape[1])
            points = np.pad(points, ((0, 0), (0, wide - points.shape[1])))
            id = rows.column("id")
            shard = Shard(
                pc.fill_null(id, _LAST).to_numpy(zero_copy_only=False), pc.is_valid(id).to_numpy(zero_copy_only=False), points
            )
            for query, own in zip(np.pad(queries, ((0, 0), (0, wide - queries.shape[1]))), best, strict=True):
                shard.search(query, own)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += len(batch.column("v").flatten()) + batch.num_rows
            if size >= SHARD:
                ask()
                held.clear()
                size = 0
        if held:
            ask()
        for n, own in zip(number.tolist(), best, strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own.id), n)), pa.array(own.id, mask=~own.named), pa.array(own.score)],
                ["query", "id", "score"],
            )

    return search


def _groups(asked: DataFrame) -> Iterator[DataFrame]:
    """Queries as (query, id, v) in groups of bounded size; a group is one written file."""
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not shape["n"]:
        return
    most = max(1, GROUP // max(1, shape["width"]))
    numbered = asked.repartition(math.ceil(shape["n"] / most)).select(F.monotonically_increasing_id().alias("query"), "id", "v")
    table, _ = written(numbered, "queries", maxRecordsPerFile=2 * most)
    for file in sorted(table.inputFiles()):
        yield table.sparkSession.read.schema(table.schema).parquet(file)


def search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = K,
    qid: str = "query_id",
    id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = SCALE,
    own: bool = False,
) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries``, as (qid, rank, id, score). ``own`` says that
    queries are rows of ``vectors``, whose own row is not an answer."""
    spark = vectors.sparkSession
    asked = whole.integers(queries.where(F.col(qid).isNotNull()), qid, embedding, scale)
    asked = asked.select(F.col("id").cast("long").alias("id"), "v")
    stored = whole.integers(vectors, id, embedding, scale).select(F.col("id").cast("long").alias("id"), "v")
    most = k + 1 if own else k
    schema = f"`{qid}` long, rank int, `{id}` long, score long"
    results = []
    for group in _groups(asked):
        rows = group.toArrow().combine_chunks()  # at most GROUP components, twice over
        points = whole.matrix(rows.column("v").combine_chunks())
        number = rows.column("query").to_numpy()
        sent = spark.sparkContext.broadcast((number, points))
        found, _ = written(stored.mapInArrow(_searcher(sent, most), "query long, id long, score long"), "found")
        sent.unpersist()
        square = F.aggregate("v", F.lit(0).cast("long"), lambda total, x: total + x * x)
        results.append(_merged(found, group.select("query", F.col("id").alias("of"), square.alias("square")), k, most, own))
    if not results:
        return spark.createDataFrame([], schema)
    whole_result = results[0]
    for more in results[1:]:
        whole_result = whole_result.unionAll(more)
    return whole_result.select(F.col("of").alias(qid), "rank", F.col("id").alias(id), "score")


def _merged(found: DataFrame, asked: DataFrame, k: int, most: int, own: bool) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    parts = Window.partitionBy("query", "part").orderBy(*order)
    some = (
        found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
        .withColumn("place", F.row_number().over(parts))
        .where(F.col("place") <= most)
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    best = some.withColumn("place", place).where(F.col("place") <= most).join(asked, "query")
    if own:
        # Of the rows with the query's id and its own score the first is taken for its own row.
        same = F.coalesce((F.col("id") == F.col("of")) & (F.col("score") == F.col("square")), F.lit(False))
        earliest = F.min(F.when(same, F.col("place"))).over(Window.partitionBy("query"))
        best = best.withColumn("own", earliest).where(~F.col("place").eqNullSafe(F.col("own")))
        best = best.withColumn("place", F.col("place") - F.when(F.col("place") > F.col("own"), 1).otherwise(0))
    return best.where(F.col("place") <= k).select("of", F.col("place").cast("int").alias("rank"), "id", "score")

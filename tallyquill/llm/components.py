"""Connected components of links between long ids, by rounds of joins.

Each task first joins what it can with union-find, and hands on one link per id. Then rounds of
large and small stars (every id passes the least of its neighbours on) run until nothing changes;
the number of rounds grows with the logarithm of the longest path. Each round is written to the
shared folder, so that lineage stays short and no executor holds the only copy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyquill.session import discard, written

#: Links that a task joins at a time.
CHUNK = 400_000


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    seen = 0

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def flushed() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_pydict(
            {"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([r for _, r in pairs], pa.int64())}
        )

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= CHUNK:
            yield flushed()
            parent.clear()
            seen = 0
    yield flushed()


def _star(links: DataFrame) -> DataFrame:
    """One large star and one small star. Links are (a, b) with a > b."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("least"))
    large = (
        both.where("b > a")
        .join(least, F.col("a") == F.col("u"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )
    lower = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least"))
    joined = large.join(lower, F.col("a") == F.col("u"))
    return (
        joined.where("b > least")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionAll(lower.select(F.col("u").alias("a"), F.col("least").alias("b")))
        .distinct()
    )


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(a, b) links of any direction -> (a, b): every id that is not the least of its component,
    with the least one. Also the folder the result is written in."""
    spark = links.sparkSession
    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    current, path = written(pairs.mapInArrow(_forest, "a long, b long").distinct(), "links")
    state = None
    while True:
        after = current.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if after == state or not after[0]:
            return current, path
        state = after
        following, new = written(_star(current), "links")
        discard(spark, path)
        current, path = following, new

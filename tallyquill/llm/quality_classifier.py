"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams are counted: one on target text (labelled good),
one on all raw text. A document's weight is the ratio of its likelihoods under both.
Documents are drawn without replacement in proportion to their weights by the Gumbel top-k
rule: a Gumbel variable, fixed by the document's id, is added to the log weight, and the k
highest sums are chosen. By default k is the share of target text among the labelled documents.

The raw model and the draw cover all documents. The target model is fitted on a bounded sample:
``MOST_LABELS`` labelled rows, those whose id has the least hash; their ids travel with the job, so
that one scan counts both models and documents are not shuffled. The k-th highest sum is
found exactly, by counting documents in finer and finer intervals; no sort of all documents and
no list of them on the driver is needed.

Defined results. A null or empty text has no n-grams and log weight 0. Rows without id share one Gumbel
variable of their own. Documents tied at the k-th place are all chosen. Rows with one id and text get equal
results. Labels without a document, with nulls, or repeated do no harm: an id is target text if
all its labels say so. Without labels, or without documents, all log weights are 0 and
all documents are chosen. Columns besides those named are not looked at. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyquill.llm import tokens
from tallyquill.session import written

#: Hash buckets: 2^18 for single words, 2^12 for pairs; the count that every bucket has
#: beforehand in both models, so that rare n-grams say little.
WORD_BITS, PAIR_BITS = 18, 12
BUCKETS = (1 << WORD_BITS) + (1 << PAIR_BITS)
SMOOTHING = 20.0
MOST_LABELS = 50_000
SEED = 1


def grams(words: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every unigram and bigram."""
    row, _, pairs = tokens.windows(words, 2)
    single = (tokens.mix(words.hash) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    double = (pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + (1 << WORD_BITS)
    return np.concatenate([words.row, row]), np.concatenate([single, double])


def _split(texts: pa.Array) -> tokens.Words:
    return tokens.words_of(texts, tokens.SPACE)


def labelled(labels: DataFrame, id: str, quality: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the sample, sorted, and whether each is target text. Bounded by ``most``."""
    good = F.col(quality) == 1
    rows = (
        labels.where(F.col(id).isNotNull() & F.col(quality).isNotNull())
        .groupBy(F.col(id).cast("long").alias("id"))
        .agg(F.min(good.cast("int")).alias("good"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
        .toPandas()
        .sort_values("id")
    )
    return rows["id"].to_numpy(dtype=np.int64), rows["good"].to_numpy(dtype=bool)


def _counter(target):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = target.value
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for piece in tokens.pieces(batches, "text"):
            row, bucket = grams(_split(piece.column("text")))
            raw += np.bincount(bucket, minlength=BUCKETS)
            own, named = _ids(piece)
            chosen = np.isin(own, ids) & named
            good += np.bincount(bucket[chosen[row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(good[some]), pa.array(raw[some])], ["bucket", "good", "raw"])

    return count


def fit(docs: DataFrame, target: np.ndarray, id: str = "doc_id", text: str = "text") -> np.ndarray:
    """The log ratio of both models for every bucket. ``target`` has the ids of target text."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    counted = (
        rows.mapInArrow(_counter(context.broadcast(target)), "bucket long, good long, raw long")
        .groupBy("bucket")
        .agg(F.sum("good").alias("good"), F.sum("raw").alias("raw"))
        .toPandas()  # one row per bucket
    )
    good, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    good[counted["bucket"]] = counted["good"]
    raw[counted["bucket"]] = counted["raw"]
    if not good.sum():
        return np.zeros(BUCKETS)
    # Raw counts are brought to the size of the target sample before both get the same prior.
    return np.log(good + SMOOTHING) - np.log(raw * (good.sum() / raw.sum()) + SMOOTHING)


def _ids(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which rows have one."""
    column = piece.column("id")
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def gumbel(ids: np.ndarray, named: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A standard Gumbel variable for each id, and one of its own for rows without id."""
    with np.errstate(over="ignore"):
        drawn = tokens.mix(tokens.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) ^ np.uint64(seed))
        drawn = np.where(named, drawn, tokens.mix(drawn + np.uint64(1)))
    uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(uniform))


def rank_of(score: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = (score + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64((1 << 63) - 1))


def _scorer(ratios, seed: int):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for piece in tokens.pieces(batches, "text"):
            row, bucket = grams(_split(piece.column("text")))
            weight = np.bincount(row, weights=table[bucket], minlength=piece.num_rows).astype(np.float64)
            n = np.bincount(row, minlength=piece.num_rows).astype(np.int64)
            total = weight + gumbel(*_ids(piece), seed)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(n), pa.array(weight), pa.array(total), pa.array(rank_of(total))],
                ["id", "n_grams", "log_weight", "score", "rank"],
            )

    return score


def kth_highest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th highest of a column of longs, exactly: 16 bits in each of four counts."""
    low, left = -(1 << 63), k
    for shift in (48, 32, 16, 0):
        width = 1 << shift
        inside = rows.where(F.col(column) >= low)
        if shift < 48:
            inside = inside.where(F.col(column) <= low + (width << 16) - 1)
        counts = inside.groupBy(F.shiftright(column, shift).alias("part")).count().collect()  # 65,536 rows at most
        for part, count in sorted(((r["part"], r["count"]) for r in counts), reverse=True):
            if left <= count:
                low = part << shift
                break
            left -= count
        else:
            return None
    return low


def choose(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality",
    share: float | None = None, most_labels: int = MOST_LABELS, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: id, n_grams, log_weight, score, kept."""
    ids, good = labelled(labels, id, quality, most_labels)
    if share is None:
        share = float(good.mean()) if len(good) else 1.0
    context = docs.sparkSession.sparkContext
    ratios = context.broadcast(fit(docs, ids[good], id, text))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, n_grams long, log_weight double, score double, rank long"
    scored, _ = written(rows.mapInArrow(_scorer(ratios, seed), schema), "scores")
    n = scored.count()
    last = kth_highest(scored, "rank", max(1, round(share * n))) if n else None
    kept = F.lit(True) if last is None else F.col("rank") >= last
    return scored.select(F.col("id").alias(id), "n_grams", "log_weight", "score", kept.alias("kept"))

"""The vector store as one table: (collection, id, source, text, embedding, ...).

The functions up to ``dedup_nearest`` say what a change means, from table to table. The stored
table is a Parquet folder partitioned by collection (or by another column with few values). A change
finds the files that hold a row it touches, writes what is left of them and what is new to a folder of
its own, and swaps these files in; all other files stay as they are. Bloom filters on id and source let
the search for a few keys skip what cannot hold them. One writer at a time; a change that was
interrupted is finished, or dropped if it had not been written whole, by the next one.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tallyquill.functions.embedding import HASH64, hash64
from tallyquill.functions.text import snippet
from tallyquill.session import discard, many_folders

# Lengths shown by the inspection reports.
SAMPLE_CHARS = 50
SHORT_CHARS = 10
SAMPLE_DIMS = 10
PREVIEW_DIMS = 5


def with_payload(found: DataFrame, store: DataFrame, *fields: str) -> DataFrame:
    """Add stored fields to search hits; the hits are few, the store is read once."""
    return found.join(store.select("id", *fields), "id")


def embed(chunks: DataFrame, text: str = "text", embedder=hash64, embedder_id: str = HASH64) -> DataFrame:
    """Add ``embedding`` and the embedder's name. ``embedder`` maps a text column to a
    vector column, built-in or an Arrow function around a model."""
    return chunks.withColumn("embedding", embedder(F.col(text))).withColumn("embedder_id", F.lit(embedder_id))


#: A model's answer to one text: its vector, or why there is none.
Answer = Sequence[float] | Exception


def _ask(model: Callable[[list[str]], Sequence[Answer]], texts: list[str]) -> list[Answer]:
    """One call. A call that raises, or answers another number of texts, fails for all of its texts."""
    try:
        answers = list(model(texts))
    except Exception as problem:  # noqa: BLE001
        return [problem] * len(texts)
    if len(answers) != len(texts):
        return [ValueError(f"{len(answers)} answers to {len(texts)} texts")] * len(texts)
    return answers


def _answers(
    model: Callable[[list[str]], Sequence[Answer]], texts: list[str], attempts: int, wait_seconds: float
) -> list[tuple[list[float] | None, str | None, int]]:
    """(vector, error, attempts) per text. Only texts that failed are sent again, in ever smaller calls; in the
    last attempt each is alone, so that no text fails because of another."""
    found: list = [None] * len(texts)
    left = list(range(len(texts)))
    for attempt in range(1, attempts + 1):
        if not left:
            break
        if attempt > 1:
            time.sleep(wait_seconds)
        step = math.ceil(len(left) ** ((attempts - attempt) / max(1, attempts - 1))) if attempts > 1 else 1
        failed = []
        for start in range(0, len(left), step):
            places = left[start : start + step]
            for place, answer in zip(places, _ask(model, [texts[p] for p in places])):
                if isinstance(answer, Exception):
                    found[place] = (None, f"{type(answer).__name__}: {answer}", attempt)
                    failed.append(place)
                else:
                    found[place] = ([float(x) for x in answer], None, attempt)
        left = failed
    return found


def embed_batches(
    chunks: DataFrame,
    model: Callable[[list[str]], Sequence[Answer]],
    attempts: int = 3,
    wait_seconds: float = 2.0,
    batch: int = 64,
) -> DataFrame:
    """Embed with a model that takes up to ``batch`` texts at once and may fail. Every chunk keeps its row: a
    failure leaves a NULL vector, the last error and the number of attempts next to it; so does a null text,
    which is not sent."""

    @F.pandas_udf("embedding array<double>, error string, attempts int")
    def call(texts: pd.Series) -> pd.DataFrame:
        rows: list = [(None, "ValueError: no text", 0)] * len(texts)
        present = [i for i, text in enumerate(texts) if text is not None]
        for start in range(0, len(present), batch):
            places = present[start : start + batch]
            for place, row in zip(places, _answers(model, [texts[p] for p in places], attempts, wait_seconds)):
                rows[place] = row
        return pd.DataFrame(rows, columns=["embedding", "error", "attempts"])

    return chunks.withColumn("called", call("text")).select("*", "called.*").drop("called")


def embed_with_retry(chunks: DataFrame, model, attempts: int = 3, wait_seconds: float = 2.0) -> DataFrame:
    """The same with a model of one text, which raises where it fails."""

    def each(texts: list[str]) -> list[Answer]:
        return [_ask(lambda one: [model(one[0])], [text])[0] for text in texts]

    return embed_batches(chunks, each, attempts, wait_seconds)


def append(store: DataFrame, chunks: DataFrame) -> DataFrame:
    return store.unionByName(chunks)


def latest(updates: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row per key. Spark keeps one row per key and task before the shuffle, so a
    key with very many versions does not fill one task."""
    last_first = W.partitionBy(*keys).orderBy(*(column.desc() for column in order))
    numbered = updates.withColumn("_place", F.row_number().over(last_first))
    return numbered.where("_place = 1").drop("_place")


def _without(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the others'. A null is a value like any other."""
    named = others.select(*(F.col(key).alias(f"_other_{i}") for i, key in enumerate(keys))).distinct()
    same = [F.col(key).eqNullSafe(F.col(f"_other_{i}")) for i, key in enumerate(keys)]
    return rows.join(named, reduce(Column.__and__, same), "left_anti")


def upsert(store: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add or replace rows by key."""
    return _without(store, updates, keys).unionByName(latest(updates, keys, order))


def add_missing(store: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The chunks that are not stored yet."""
    return _without(chunks, store, keys)


def delete_sources(store: DataFrame, sources: DataFrame) -> DataFrame:
    return _without(store, sources, ["source"])


def replace_sources(store: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace everything a changed source had, so no stale tail of chunks stays behind."""
    return delete_sources(store, updates).unionByName(updates)


def first_copies(chunks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first chunk per key; copies are reduced within each task before the shuffle."""
    numbered = chunks.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.where("_place = 1").drop("_place")


def dedup_content(chunks: DataFrame, order: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """Keep the first chunk of each text per collection, identified by its md5."""
    keyed = chunks.withColumn("content_id", F.md5("text"))
    kept = first_copies(keyed, ["collection", "content_id"], order)
    return kept if stored is None else add_missing(stored, kept, ["collection", "content_id"])


def dedup_nearest(chunks: DataFrame, order: Sequence[str], embedder=hash64) -> DataFrame:
    """Keep a chunk only when no earlier chunk of its collection lies at distance 0 from it.
    Chunks at distance 0 have equal vectors, so equality of vectors replaces a search per
    chunk; chunks without a vector are compared by text."""
    vector_id = F.coalesce(F.md5(F.to_json(embedder(F.col("text")))), F.md5("text"))
    return first_copies(chunks.withColumn("vector_id", vector_id), ["collection", "vector_id"], order)


# --- the stored table -----------------------------------------------------------------


class EmptyName(Exception):
    """A collection named by an empty text, which a folder cannot tell from one without a name."""


def _checked(rows: DataFrame, by: str) -> DataFrame:
    """Fails while writing where a partition would be named by an empty text."""
    if not isinstance(rows.schema[by].dataType, StringType):
        return rows
    refused = F.raise_error(F.lit(f"{EmptyName.__name__}: {by}")).cast("string")
    return rows.withColumn(by, F.when(F.col(by) == "", refused).otherwise(F.col(by)))


#: Columns that changes are found by; their Bloom filters are as large as their values need.
MARKED = ("id", "source")


def _writer(rows: DataFrame, by: str) -> DataFrameWriter:
    marked = {f"parquet.bloom.filter.enabled#{name}": "true" for name in MARKED if name in rows.columns}
    options = {"parquet.bloom.filter.adaptive.enabled": "true", **marked}
    return _checked(rows, by).write.options(**options).partitionBy(by)


def create(rows: DataFrame, path: str, by: str = "collection") -> None:
    _writer(rows, by).parquet(path)


def add(rows: DataFrame, path: str, by: str = "collection") -> None:
    """Append chunks; nothing that is stored is read."""
    _writer(rows, by).mode("append").parquet(path)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored table. The schema is given, so that names of collections stay text."""
    with many_folders(spark):
        return spark.read.schema(schema).parquet(path)


FILE = "_metadata.file_path"
#: Folder of changes under way; Spark does not read names that begin with a low line.
CHANGES = "_changes"
#: Names the files that a change replaces; it is there once all of the change's own files are.
REPLACES = "_replaces"
#: Up to so many keys are looked for by value, which Bloom filters answer; more of them by a join.
FEW_KEYS = 1000
#: Spark pushes so many values of one list down to the files.
PUSHED_VALUES = 10


def _among(column: str, values: Sequence[object]) -> Column:
    """The column is one of the values, null being one like any other."""
    present = [value for value in values if value is not None]
    parts = [F.col(column).isin(present[i : i + PUSHED_VALUES]) for i in range(0, len(present), PUSHED_VALUES)]
    if len(present) < len(values):
        parts.append(F.col(column).isNull())
    return reduce(Column.__or__, parts)


def holding(stored: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(file) of the stored files that hold one of the wanted keys. Only key columns are read, and of files
    that cannot hold one of a few keys only what says so."""
    named = wanted.select(*(F.col(key).alias(f"_wanted_{i}") for i, key in enumerate(keys))).distinct()
    few = [tuple(row) for row in named.limit(FEW_KEYS + 1).collect()] if len(keys) == 1 else []
    if few and len(few) <= FEW_KEYS:
        held = stored.where(_among(keys[0], [row[0] for row in few])).select(F.col(FILE).alias("file"))
    else:
        same = [F.col(key).eqNullSafe(F.col(f"_wanted_{i}")) for i, key in enumerate(keys)]
        held = stored.select(*keys, F.col(FILE).alias("file")).join(named, reduce(Column.__and__, same), "left_semi")
    return held.select("file").distinct()


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _finish(spark: SparkSession, path: str, change: str) -> None:
    """Swap a change's files in: first the new ones are moved, then the replaced ones deleted. Each step may be repeated."""
    system, Path = _files(spark, path)
    listed = system.open(Path(f"{change}/{REPLACES}"))
    replaced = spark._jvm.org.apache.commons.io.IOUtils.toString(listed, "UTF-8").split("\n")
    listed.close()
    moving, start = system.listFiles(Path(change), True), len(system.makeQualified(Path(change)).toString()) + 1
    new = []
    while moving.hasNext():
        new.append(moving.next().getPath())
    made = set()
    for file in new:
        place = file.toString()[start:]
        if "/" in place:  # a file of a partition
            target, folder = Path(f"{path}/{place}"), place.rpartition("/")[0]
            if folder not in made:
                system.mkdirs(target.getParent())
                made.add(folder)
            system.rename(file, target)
    URI, folders = spark._jvm.java.net.URI, {}
    for name in filter(None, replaced):
        old = Path(URI(name))  # Spark names files as URIs
        system.delete(old, False)
        folders[name.rpartition("/")[0]] = old.getParent()
    for folder in folders.values():
        if system.exists(folder) and not system.listStatus(folder):
            system.delete(folder, False)
    discard(spark, change)


def recover(spark: SparkSession, path: str) -> None:
    """Finish the changes that were interrupted while they were swapped in, and drop those that were not yet written whole."""
    system, Path = _files(spark, path)
    changes = Path(f"{path}/{CHANGES}")
    for found in system.listStatus(changes) if system.exists(changes) else []:
        change = f"{path}/{CHANGES}/{found.getPath().getName()}"
        if system.exists(Path(f"{change}/{REPLACES}")):
            _finish(spark, path, change)
        else:
            discard(spark, change)


def _prepare(
    stored: DataFrame, path: str, wanted: DataFrame, keys: Sequence[str], new: DataFrame | None, by: str
) -> str | None:
    """Write a change whole: the rows of the files that hold a wanted key, without those that have one,
    and the new rows. The names of the files pass through the driver. Returns its folder, None if nothing changes."""
    spark = stored.sparkSession
    names = [row.file for row in holding(stored, wanted, keys).collect()]
    # Spark lists only these files for the condition on their names.
    rows = _without(stored.where(F.col(FILE).isin(names)), wanted, keys).select(*stored.columns) if names else None
    parts = [part for part in (rows, None if new is None else new.select(*stored.columns)) if part is not None]
    if not parts:
        return None
    change = f"{path}/{CHANGES}/{uuid.uuid4().hex}"
    _writer(reduce(DataFrame.unionByName, parts), by).parquet(change)
    system, Path = _files(spark, path)
    out = system.create(Path(f"{change}/{REPLACES}.part"))
    out.write(bytearray("\n".join(names), "utf-8"))
    out.close()
    system.rename(Path(f"{change}/{REPLACES}.part"), Path(f"{change}/{REPLACES}"))
    return change


def _swap(
    stored: DataFrame, path: str, wanted: DataFrame, keys: Sequence[str], new: DataFrame | None, by: str
) -> None:
    change = _prepare(stored, path, wanted, keys, new, by)
    if change is not None:
        _finish(stored.sparkSession, path, change)


def _current(stored: DataFrame, path: str) -> DataFrame:
    """The stored table after interrupted changes have been dealt with."""
    recover(stored.sparkSession, path)
    return read(stored.sparkSession, path, stored.schema)


def exists(spark: SparkSession, path: str) -> bool:
    system, Path = _files(spark, path)
    return system.exists(Path(path))


def delete_sources_within(
    spark: SparkSession, path: str, schema: StructType, sources: DataFrame, places: Sequence[str], by: str = "collection"
) -> None:
    """Delete all chunks of the listed sources, which lie in these partitions alone: only their folders are
    listed, however many others there are. Names of partitions must be safe names; a null is one without a name."""
    recover(spark, path)
    folders = [f"{path}/{by}={'__HIVE_DEFAULT_PARTITION__' if place is None else place}" for place in places]
    system, Path = _files(spark, path)
    present = [folder for folder in folders if system.exists(Path(folder))]
    if present:
        with many_folders(spark):
            stored = spark.read.schema(schema).option("basePath", path).parquet(*present)
        _swap(stored, path, sources, ["source"], None, by)


def upsert_into(
    stored: DataFrame, path: str, updates: DataFrame, keys: Sequence[str], order: Sequence[Column], by: str = "collection"
) -> None:
    """Add or replace rows by key. A key stays in its collection; rows without a collection are one."""
    stored = _current(stored, path)
    places = [row[0] for row in updates.select(by).distinct().collect()]
    if places:
        named = stored.where(_among(by, places))
        _swap(named, path, updates, keys, latest(updates, keys, order), by)


def replace_sources_in(stored: DataFrame, path: str, updates: DataFrame, by: str = "collection") -> None:
    """Replace everything the changed sources had, wherever it is stored."""
    _swap(_current(stored, path), path, updates, ["source"], updates, by)


def delete_sources_in(stored: DataFrame, path: str, sources: DataFrame, by: str = "collection") -> None:
    """Delete all chunks of the listed sources."""
    _swap(_current(stored, path), path, sources, ["source"], None, by)


# --- reading --------------------------------------------------------------------------


def get(store: DataFrame, collection: str, fields: Sequence[str]) -> DataFrame:
    """Chosen fields of one collection; of a stored table only its partition is read."""
    return store.where(F.col("collection") == collection).select("id", *fields)


def list_collections(store: DataFrame) -> DataFrame:
    """Collection names with the total number next to each."""
    names = store.select("collection").where("collection IS NOT NULL").distinct()
    return names.withColumn("total_collections", names.agg(F.count("*")).scalar())


def inspect(store: DataFrame, order: str) -> DataFrame:
    """Counts and one sample per collection."""
    sample = F.min_by(
        F.struct(
            F.substring("text", 1, SAMPLE_CHARS).alias("text"),
            F.col("source"),
            F.slice("embedding", 1, SAMPLE_DIMS).alias("embedding"),
        ),
        F.col(order),
    )
    return (
        store.groupBy("collection")
        .agg(
            F.count("text").alias("documents"),
            F.count("source").alias("metadatas"),
            F.count("embedding").alias("embeddings"),
            sample.alias("sample"),
        )
        .select(
            "collection",
            "documents",
            "metadatas",
            "embeddings",
            F.col("sample.text").alias("sample_document"),
            F.col("sample.source").alias("sample_source"),
            F.col("sample.embedding").alias("sample_embedding"),
        )
    )


def preview(store: DataFrame, chars: int = SAMPLE_CHARS, dims: int = PREVIEW_DIMS) -> DataFrame:
    return store.select(
        "collection",
        "id",
        "source",
        snippet(F.col("text"), chars).alias("preview"),
        F.slice("embedding", 1, dims).alias("first_dims"),
    )


#: What ``observed`` counts.
OBSERVED = ("chunks", "embeddings", "failures", "characters")


def observed(chunks: DataFrame) -> tuple[DataFrame, Observation]:
    """The chunks, and counts that are there once an action has gone over all of them: whoever
    writes the chunks counts them on the way."""
    counts = Observation()
    missing = F.count(F.when(F.col("embedding").isNull(), 1))
    values = (F.count(F.lit(1)), F.count("embedding"), missing, F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)))
    return chunks.observe(counts, *(value.alias(name) for value, name in zip(values, OBSERVED, strict=True))), counts


def ingest_metrics(chunks: DataFrame) -> DataFrame:
    """Chunks, embeddings, failures and exact copies per source.

    Copies are counted from one row per source and text, so a text with very many copies
    is reduced before the shuffle.
    """
    per_text = chunks.groupBy("source", F.md5("text").alias("content_id")).agg(
        F.count("*").alias("rows"), F.count("embedding").alias("embedded")
    )
    return per_text.groupBy("source").agg(
        F.sum("rows").alias("chunks"),
        F.sum("embedded").alias("embeddings"),
        (F.sum("rows") - F.sum("embedded")).alias("failures"),
        (F.sum("rows") - F.count("*")).alias("duplicates"),
    )

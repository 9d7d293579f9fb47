"""Stock that is kept up to date as sales and movements arrive.

Spark's state store holds one row per product and warehouse: the latest stock, or the sum of all movements.
A micro-batch puts out the keys it has touched with their new values, so that a late movement brings its key
out again. The values are whole and not changes: merging a batch a second time alters nothing. Every key keeps a row of state:
Spark's default store holds all of them, in two versions, on the heap; ``STATE`` keeps them on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyquill.operators import inventory, store
from tallyquill.session import discard, written
from tallyquill.streaming.timers import ROCKSDB

KEYS = ("product_id", "warehouse")

#: Settings of a session whose streams keep stock: the memory of all stores of a machine has one bound.
STATE = {**ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}
ADAPTIVE = "spark.sql.adaptive.enabled"


def on_hand(movements: DataFrame) -> DataFrame:
    """Sum of ``delta`` per product and warehouse, with the number of movements and the last date.
    Movements without a key, date or delta are left out."""
    usable = [F.col(c).isNotNull() for c in (*KEYS, "date", "delta")]
    return (
        movements.where(usable[0] & usable[1] & usable[2] & usable[3])
        .groupBy(*KEYS)
        .agg(F.sum("delta").alias("on_hand"), F.count("*").alias("movements"), F.max("date").alias("last_moved"))
    )


def latest(sales: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """``inventory.inventory_state`` of a stream: stock by the newest date, whenever it arrives."""
    return inventory.inventory_state(sales, tiebreak)


def merge_into(path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """Sink that adds or replaces the rows of a batch by key; only partitions of warehouses
    in the batch are read and written. A merge looks at its rows several times, so they are written once:
    each time the batch itself is asked for them, Spark shuffles its input and opens its state again. A stream's session
    does not plan adaptively, so that a state partition stays where it is; a merge is no part of the stream, and
    without it writes a file per warehouse and state partition, however small."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, place = written(batch.select(*schema.names), "batch")
        conf = rows.sparkSession.conf
        before = conf.get(ADAPTIVE)
        conf.set(ADAPTIVE, "true")
        try:
            stored = _stored(rows.sparkSession, path, schema)
            if stored is None:
                store.create(rows, path, by="warehouse")
            else:
                # A key stands once in a batch, so that no order among versions is needed.
                store.upsert_into(stored, path, rows, KEYS, [F.lit(batch_id)], by="warehouse")
        finally:
            conf.set(ADAPTIVE, before)
            discard(rows.sparkSession, place)

    return write


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return store.read(spark, path, schema)


def keep(updates: DataFrame, path: str, checkpoint: str, writer: Callable[[DataFrame, int], None] | None = None):
    """Merge everything that has arrived since the last run into the table, then stop."""
    return (
        updates.writeStream.outputMode("update")
        .foreachBatch(writer or merge_into(path, updates.schema))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

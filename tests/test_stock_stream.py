import os
import uuid

import pytest
from pyspark.sql import functions as F

from tallyquill.plans import streams
from tallyquill.streaming import stock

SCHEMA = "product_id int, warehouse string, date date, delta long"


def moves(spark, *rows):
    return spark.createDataFrame(list(rows), "product_id int, warehouse string, day string, delta long").selectExpr(
        "product_id", "warehouse", "cast(day as date) as date", "delta"
    )


def test_late_movements_and_a_replayed_batch(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    deliveries = [
        moves(spark, (1, "a", "2024-01-05", 10), (1, "b", "2024-01-05", 4), (2, "a", "2024-01-05", 7)),
        moves(spark, (1, "a", "2024-01-02", -3), (None, "a", "2024-01-02", 9), (2, None, "2024-01-02", 9)),  # late, and without a key
        moves(spark, (1, "a", "2024-01-09", 1), (3, "c", "2024-01-09", None), (3, "b", "2024-01-09", 5)),
    ]
    failures, emitted = [], []
    for n, rows in enumerate(deliveries):
        rows.write.mode("append").parquet(folder)
        updates = stock.on_hand(spark.readStream.schema(rows.schema).parquet(folder))
        merge = stock.merge_into(out, updates.schema)

        def lost_once(batch, batch_id, n=n, merge=merge):
            merge(batch, batch_id)
            emitted.append(sorted((r.product_id, r.warehouse) for r in batch.collect()))
            if n == 1 and not failures:
                failures.append(batch_id)
                raise RuntimeError("lost after merging")

        if n == 1:
            with pytest.raises(Exception, match="lost after merging"):
                stock.keep(updates, out, checkpoint, lost_once).awaitTermination()
        stock.keep(updates, out, checkpoint, lost_once).awaitTermination()
    # The late movement brings out its own key only, and again when its batch is repeated.
    assert [e for e in emitted if e] == [[(1, "a"), (1, "b"), (2, "a")], [(1, "a")], [(1, "a")], [(1, "a"), (3, "b")]]
    found = stock._stored(spark, out, updates.schema).collect()
    assert sorted((r.product_id, r.warehouse, r.on_hand, r.movements, str(r.last_moved)) for r in found) == [
        (1, "a", 8, 3, "2024-01-09"), (1, "b", 4, 1, "2024-01-05"), (2, "a", 7, 1, "2024-01-05"), (3, "b", 5, 1, "2024-01-09"),
    ]


def test_a_merge_asks_a_batch_for_its_rows_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def counted(value):
        asked.add(1)
        return value

    rows = spark.range(60).selectExpr(
        "cast(id as int) AS product_id", "concat('w', id % 3) AS warehouse", "id AS on_hand", "1L AS movements", "date '2024-01-01' AS last_moved"
    )
    udf = F.udf(counted, "long").asNondeterministic()
    merge = stock.merge_into(str(tmp_path / "out"), rows.schema)
    merge(rows.where("product_id < 40"), 0)
    merge(rows.where("product_id >= 20").withColumn("on_hand", udf(F.col("on_hand") + 100)), 1)
    assert asked.value == 40
    found = stock._stored(spark, str(tmp_path / "out"), rows.schema).collect()
    assert sorted((r.product_id, r.on_hand) for r in found) == [(i, i if i < 20 else i + 100) for i in range(60)]


def test_kept_stock_holds_its_state_on_disk_and_merges_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "fresh_path", lambda spark, label: f"{tmp_path}/{label}-{uuid.uuid4().hex}")
    rows = spark.range(300).selectExpr(
        "id AS l_orderkey", "cast(id % 50 as int) AS product_id", "concat('w', id % 5) AS warehouse", "date '2024-01-01' AS date", "1L AS delta"
    )
    names = [*stock.STATE, "spark.sql.shuffle.partitions", stock.ADAPTIVE]
    before = {name: spark.conf.get(name, None) for name in names}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = streams.kept_stock(spark, rows, stock.on_hand)
        assert sorted((r.product_id, r.on_hand, r.movements) for r in found.collect()) == [(i, 6, 6) for i in range(50)]
        assert len(found.inputFiles()) <= 5 * spark.sparkContext.defaultParallelism  # not one per warehouse and state partition
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before["spark.sql.shuffle.partitions"])
    assert {name: spark.conf.get(name, None) for name in names} == before
    state = [file for place in tmp_path.glob("checkpoint-*/state") for _, _, files in os.walk(place) for file in files]
    assert any(file.endswith(".zip") for file in state) and not any(file.endswith(".delta") for file in state)

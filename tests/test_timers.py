import random

import pytest
from pyspark.sql import functions as F

from tallyquill.operators import events as ev
from tallyquill.streaming import timers

START = 1_704_067_200_000_000


@pytest.fixture(scope="module")
def rocksdb(spark):
    before = {name: spark.conf.get(name, None) for name in timers.ROCKSDB}
    for name, value in timers.ROCKSDB.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def arrivals(seed, n):
    """Events in bursts and pauses, that arrive out of order by less than ten minutes."""
    pick = random.Random(seed)
    at, rows = START, []
    for i in range(n):
        at += pick.choice((300_000, 900_000, 2_000_000, 2_000_000, 31_000_000, 200_000_000))
        rows.append((pick.choice("abc"), at, i))
    return sorted(rows, key=lambda row: row[1] + pick.randrange(500_000_000))


def table(spark, rows):
    frame = spark.createDataFrame(rows, "path string, at long, event_id long")
    return frame.select("path", F.timestamp_micros("at").alias("ts"), "event_id")


def deliver(spark, tmp_path, rows, build, parts=4):
    """Results of a stream over several deliveries, and after each one."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for i in range(parts):
        cut = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        table(spark, cut).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(table(spark, []).schema).parquet(folder)
        query = (
            build(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        seen.append((spark.read.parquet(out).count(), query.lastProgress["stateOperators"][0]["numRowsTotal"]))
    return spark.read.parquet(out), seen


FLUSH = [("z", START + 10**13, 10**6)]


def test_debounce_equals_batch_out_of_order(rocksdb, tmp_path):
    rows = arrivals(1, 400)
    found, seen = deliver(rocksdb, tmp_path, [*rows, *FLUSH], lambda s: timers.debounce_stream(s, 2, "15 minutes"))
    want = ev.debounce(table(rocksdb, rows), 2)
    got = sorted((r.path, r.event_id, r.ts) for r in found.where("path <> 'z'").collect())
    assert got == sorted((r.path, r.event_id, r.ts) for r in want.collect()) and len(got) > 100
    assert seen[0][0] > 0  # accepted as they come, not at the end


def test_state_expires(rocksdb, tmp_path):
    """After the flush, the paths that have nothing more to decide are gone; the flush itself waits."""
    rows = [*arrivals(2, 60), *FLUSH]
    _, seen = deliver(rocksdb, tmp_path, rows, lambda s: timers.debounce_stream(s, 2, "15 minutes"), parts=2)
    assert [state for _, state in seen] == [3, 1]


def test_idle_reports_come_live(rocksdb, tmp_path):
    rows = arrivals(3, 300)
    found, seen = deliver(rocksdb, tmp_path, [*rows, ("z", rows[-1][1], 10**6)], lambda s: timers.idle_stream(s, 15, "15 minutes"))
    watermark = max(at for _, at, _ in rows) - 900_000_000
    want = []
    for path in "abc":
        times = sorted({at for p, at, _ in rows if p == path})
        for since, until in zip(times, [*times[1:], None]):
            # An open gap is reported up to the watermark, a closed one that the watermark has passed to its end.
            edge = min(until if until is not None else watermark - 1, watermark - 1)
            if since < watermark:
                want += [(path, since, n) for n in range(1, (edge - since) // 15_000_000 + 1)]
    micros = F.unix_micros("idle_from")
    got = [tuple(r) for r in found.where("path <> 'z'").select("path", micros, "report").collect()]
    assert sorted(got) == sorted(want) and len(got) == len(set(got)) > 100
    assert 0 < seen[0][0] < seen[1][0] < seen[2][0]

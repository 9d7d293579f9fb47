import datetime as dt
import random

import pytest

from tallyquill.operators import events as ev

START = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    """Rows of (path, seconds, id)."""
    return spark.createDataFrame(
        [(p, START + dt.timedelta(seconds=s), i) for p, s, i in rows], "path string, ts timestamp, event_id bigint"
    )


def walk(rows, gap):
    last, kept = {}, set()
    for path, at, number in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if path not in last or at - last[path] >= gap:
            last[path] = at
            kept.add(number)
    return kept


def cases():
    rng = random.Random(4)
    yield "random", [(rng.choice("ab"), round(rng.uniform(0, 3000), 3), i) for i in range(600)]
    yield "regular", [("a", 1.5 * i, i) for i in range(900)]
    yield "hot", [("a" if rng.random() < 0.7 else f"p{i % 40}", rng.randint(0, 1500), i) for i in range(1200)]
    yield "same instant", [("a", 7, i) for i in range(20)] + [("a", 9, 20), ("a", 8, 21)]
    yield "slab edges", [("a", 512 * i + d, 10 * i + n) for i in range(5) for n, d in enumerate((-1, 0, 1, 2, 3))]
    yield "sparse", [(f"p{i % 3}", 5000 * i, i) for i in range(30)]


@pytest.mark.parametrize("name, rows", list(cases()))
def test_debounce(spark, name, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "53")
    try:
        found = {r.event_id for r in ev.debounce(frame(spark, rows).repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == walk(rows, 2)


def test_last_seen_is_not_last_accepted(spark):
    rows = [("a", 0, 0), ("a", 1.5, 1), ("a", 3, 2)]
    assert {r.event_id for r in ev.debounce(frame(spark, rows)).collect()} == {0, 2}


def gaps(rows, threshold):
    times = sorted(at for _, at, _ in rows)
    return {(a, b, int((b - a) // threshold)) for a, b in zip(times, times[1:]) if b - a >= threshold}


@pytest.mark.parametrize("name, rows", list(cases()))
@pytest.mark.parametrize("threshold", [1, 15])
def test_idle_gaps(spark, name, rows, threshold):
    rows = [(p, int(s), i) for p, s, i in rows]
    found = {
        ((r.idle_from - START).total_seconds(), (r.idle_to - START).total_seconds(), r.reports)
        for r in ev.idle_gaps(frame(spark, rows), threshold).collect()
    }
    assert found == gaps(rows, threshold)


@pytest.mark.parametrize("name, rows", list(cases()))
def test_sessions(spark, name, rows):
    want = []
    last = {}
    for path, at, _ in sorted(rows):
        if path in last and at - last[path][2] < 2:
            last[path][2] = at
            last[path][3] += 1
        else:
            last[path] = [path, at, at, 1]
            want.append(last[path])
    found = [
        [r.path, (r.started - START).total_seconds(), (r.ended - START).total_seconds(), r.events]
        for r in ev.sessions(frame(spark, rows)).collect()
    ]
    assert sorted(found) == sorted(want)


def test_sessions_across_blocks(spark):
    """One session longer than a block of slabs."""
    rows = [("a", i, i) for i in range(9000)] + [("a", 20000, 9000)]
    found = sorted((r.events, (r.ended - r.started).total_seconds()) for r in ev.sessions(frame(spark, rows)).collect())
    assert found == [(1, 0.0), (9000, 8999.0)]


def test_fold(spark):
    rows = [("a", 1, "create", "f1"), ("a", 2, "modify", "f2"), ("b", 1, "create", "g"), ("b", 3, "delete", "g"), ("c", 1, "delete", "h"), ("c", 1, "create", "h")]
    events = spark.createDataFrame(
        [(p, START + dt.timedelta(seconds=s), i, e, f) for i, (p, s, e, f) in enumerate(rows)],
        "path string, ts timestamp, event_id bigint, event string, fingerprint string",
    )
    assert sorted((r.path, r.fingerprint) for r in ev.current_files(events).collect()) == [("a", "f2"), ("c", "h")]

"""File events: current state, debouncing, idle gaps and activity sessions.

Events are (path, ts, event_id, ...). Time is cut into slabs, so that one busy path
becomes many small units of work instead of one long one; what a slab needs to know from
earlier time is passed on as one small row per slab.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Waiting times of the folder monitors, in seconds.
DEBOUNCE_SECONDS = 2
IDLE_SECONDS = 15
ACTIVITY_SECONDS = 2

SECOND = 1_000_000
GAPS_PER_SLAB = 256
LONG_AGO = -(2**62)


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def fold(events: DataFrame) -> DataFrame:
    """Last event per path."""
    last = F.max_by(F.struct("event", "fingerprint", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("path").agg(last.alias("last")).select("path", "last.*")


def current_files(events: DataFrame) -> DataFrame:
    """Paths that exist after all events."""
    return fold(events).where("event <> 'delete'")


# --- debounce -----------------------------------------------------------------------


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no group is cut."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if waiting and _starts_group(waiting[-1], batch, keys):
            yield pd.concat(waiting, ignore_index=True)
            waiting = []
        same_as_last = np.ones(len(batch), dtype=bool)
        for key in keys:
            values = batch[key].to_numpy()
            same_as_last &= values == values[-1]
        cut = int(len(batch) - np.argmin(same_as_last[::-1])) if not same_as_last.all() else 0
        if cut:
            yield pd.concat([*waiting, batch[:cut]], ignore_index=True)
            waiting = []
        waiting.append(batch[cut:])
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def _starts_group(before: pd.DataFrame, batch: pd.DataFrame, keys: list[str]) -> bool:
    return any(before[key].iloc[-1] != batch[key].iloc[0] for key in keys)


def _group_starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    fresh = np.zeros(len(rows), dtype=bool)
    fresh[0] = True
    for key in keys:
        values = rows[key].to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(fresh)


def _successors(rows: pd.DataFrame, starts: np.ndarray, gap: int, width: int) -> np.ndarray:
    """Index of the next acceptable event of the same group; len(rows) when none.

    Times count from the start of their slab and groups are set far apart on one axis, so
    one search serves all groups.
    """
    group = np.zeros(len(rows), dtype=np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    inside = np.maximum(rows["at"].to_numpy() - rows["slab"].to_numpy() * width, -gap)
    axis = group * (width + 3 * gap) + inside
    found = np.searchsorted(axis, axis + gap)
    ends = np.append(starts[1:], len(rows))
    return np.where(found < ends[group], found, len(rows))


def _summaries(batches: Iterator[pd.DataFrame], gap: int, width: int) -> Iterator[pd.DataFrame]:
    """Per path and slab, the last accepted time as a step function of the first one.

    Later starts never end earlier, so it is enough to keep, for each end, the latest
    start that leads to it.
    """
    for rows in _whole_groups(batches, ["path", "slab"]):
        starts = _group_starts(rows, ["path", "slab"])
        times = rows["at"].to_numpy()
        after = _successors(rows, starts, gap, width)
        early = times - rows["slab"].to_numpy() * width < gap
        previous_early = np.append(True, early[:-1])
        previous_early[starts] = True
        candidates = np.flatnonzero(previous_early)
        chain = candidates
        while (after[chain] < len(rows)).any():
            chain = np.where(after[chain] < len(rows), after[chain], chain)
        final = times[chain]
        owner = np.searchsorted(starts, candidates, side="right") - 1
        keep = np.append((final[1:] != final[:-1]) | (owner[1:] != owner[:-1]), True)
        owner, firsts, finals = owner[keep], times[candidates][keep], final[keep]
        cuts = np.searchsorted(owner, np.arange(1, len(starts)))
        yield pd.DataFrame(
            {
                "path": rows["path"].to_numpy()[starts],
                "slab": rows["slab"].to_numpy()[starts],
                "firsts": np.split(firsts, cuts),
                "finals": np.split(finals, cuts),
            }
        )


def _entries(batches: Iterator[pd.DataFrame], gap: int) -> Iterator[pd.DataFrame]:
    """Run the last accepted time of each path through its slabs, in order."""
    path, last = None, LONG_AGO
    for batch in batches:
        entered = []
        for own, firsts, finals in zip(batch["path"], batch["firsts"], batch["finals"]):
            if own != path:
                path, last = own, LONG_AGO
            entered.append(last)
            step = int(np.searchsorted(firsts, last + gap))
            if step < len(firsts):
                last = int(finals[step])
        yield pd.DataFrame({"path": batch["path"], "slab": batch["slab"], "entry": entered})


def _accepted(batches: Iterator[pd.DataFrame], gap: int, width: int) -> Iterator[pd.DataFrame]:
    """Keep accepted events; the first row of each group carries the time it starts from."""
    for rows in _whole_groups(batches, ["path", "slab"]):
        starts = _group_starts(rows, ["path", "slab"])
        after = _successors(rows, starts, gap, width)
        taken = np.zeros(len(rows), dtype=bool)
        at = starts
        while len(at):
            at = after[at]
            at = at[at < len(rows)]
            taken[at] = True
        yield rows.loc[taken, ["path", "event_id", "at"]]


def debounce(events: DataFrame, gap_seconds: float = DEBOUNCE_SECONDS) -> DataFrame:
    """Drop an event that comes less than the gap after the last *accepted* event of the
    same path. Returns (path, event_id, ts) of the accepted events."""
    gap = int(gap_seconds * SECOND)
    width = gap * GAPS_PER_SLAB
    path_type, id_type = events.schema["path"].dataType, events.schema["event_id"].dataType
    keys = [T.StructField("path", path_type), T.StructField("slab", T.LongType())]
    times = T.ArrayType(T.LongType())
    slabbed = events.where("path IS NOT NULL AND ts IS NOT NULL").select(
        "path", "event_id", micros("ts").alias("at"), F.floor(micros("ts") / F.lit(width)).cast("bigint").alias("slab")
    )
    laid = slabbed.select("path", "slab", "at").repartition("path", "slab").sortWithinPartitions("path", "slab", "at")
    summaries = laid.mapInPandas(
        lambda batches: _summaries(batches, gap, width),
        T.StructType([*keys, T.StructField("firsts", times), T.StructField("finals", times)]),
    )
    entries = (
        summaries.repartition("path")
        .sortWithinPartitions("path", "slab")
        .mapInPandas(lambda batches: _entries(batches, gap), T.StructType([*keys, T.StructField("entry", T.LongType())]))
    )
    markers = entries.select("path", F.lit(0).cast(id_type).alias("event_id"), F.col("entry").alias("at"), "slab")
    ordered = (
        slabbed.unionByName(markers)
        .repartition("path", "slab")
        .sortWithinPartitions("path", "slab", "at", "event_id")
    )
    accepted = ordered.mapInPandas(
        lambda batches: _accepted(batches, gap, width),
        T.StructType([keys[0], T.StructField("event_id", id_type), T.StructField("at", T.LongType())]),
    )
    return accepted.select("path", "event_id", F.timestamp_micros("at").alias("ts"))


# --- gaps and sessions --------------------------------------------------------------


def idle_gaps(events: DataFrame, threshold_seconds: float = IDLE_SECONDS) -> DataFrame:
    """Stretches of at least the threshold without any event, and how many reports a
    monitor that checks at that interval gives for each.

    Two events in one slab as wide as the threshold are never a gap apart, so slabs shrink
    to their first and last event before anything is ordered. Ordering runs inside blocks
    of slabs; only one row per block is ordered over all time.
    """
    threshold = int(threshold_seconds * SECOND)
    at = micros("ts")
    edges = (F.min("at").alias("first"), F.max("at").alias("last"))
    slabs = (
        events.where("ts IS NOT NULL")
        .select(at.alias("at"), F.floor(at / F.lit(threshold)).cast("bigint").alias("slab"))
        .groupBy("slab")
        .agg(*edges)
        .withColumn("block", F.floor(F.col("slab") / 4096).cast("bigint"))
    )
    inside = W.partitionBy("block").orderBy("slab")
    within = slabs.select(F.lag("last").over(inside).alias("since"), F.col("first").alias("until"))
    blocks = slabs.groupBy("block").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    over_time = W.orderBy("block")  # one row per block of 4096 thresholds
    between = blocks.select(F.lag("last").over(over_time).alias("since"), F.col("first").alias("until"))
    length = F.col("until") - F.col("since")
    return (
        within.unionByName(between)
        .where(length >= threshold)
        .select(
            F.timestamp_micros("since").alias("idle_from"),
            F.timestamp_micros("until").alias("idle_to"),
            F.floor(length / F.lit(threshold)).cast("bigint").alias("reports"),
        )
    )


def sessions(events: DataFrame, gap_seconds: float = ACTIVITY_SECONDS) -> DataFrame:
    """Sessions of a path: an event less than the gap after the previous one continues the
    session. Returns (path, started, ended, events).

    Events in one slab as wide as the gap share a session and are reduced to one row
    first. Sessions are then built inside blocks of slabs; only the first and last session
    of a block can continue in another block and are joined in a second, small step.
    """
    gap = int(gap_seconds * SECOND)
    at = micros("ts")
    totals = (F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))

    def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = W.partitionBy(*keys).orderBy("first")
        starts = F.coalesce((F.col("first") - F.lag("last").over(order) >= gap).cast("int"), F.lit(0))
        running = order.rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumn("_starts", starts).withColumn("session", F.sum("_starts").over(running)).drop("_starts")

    slabs = (
        events.where("path IS NOT NULL AND ts IS NOT NULL")
        .select("path", at.alias("at"), F.floor(at / F.lit(gap)).cast("bigint").alias("slab"))
        .groupBy("path", "slab")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("events"))
        .withColumn("block", F.floor(F.col("slab") / 4096).cast("bigint"))
        .drop("slab")
    )
    local = numbered(slabs, ["path", "block"]).groupBy("path", "block", "session").agg(*totals)
    block = W.partitionBy("path", "block")
    marked = local.withColumn("outer", (F.col("session") == 0) | (F.col("session") == F.max("session").over(block)))
    inner = marked.where(~F.col("outer")).select("path", "first", "last", "events")
    outer = marked.where("outer").select("path", "first", "last", "events")
    joined = numbered(outer, ["path"]).groupBy("path", "session").agg(*totals).drop("session")
    return inner.unionByName(joined).select(
        "path",
        F.timestamp_micros("first").alias("started"),
        F.timestamp_micros("last").alias("ended"),
        F.col("events").cast("bigint").alias("events"),
    )

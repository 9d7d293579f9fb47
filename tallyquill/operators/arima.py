"""ARIMA(1,1,1) forecasts by conditional sum of squares on a fixed coefficient grid.

With d the differences of a series, the residuals follow
``e[t] = d[t] - phi * d[t-1] - theta * e[t-1]``. Given the coefficients this is linear
in the residual that enters a stretch of the series, so any stretch can be summed up by
three numbers per grid point and stretches can be joined later. That lets Spark range-
partition the ordered series: a product with most of the rows is spread over many tasks,
each task streams its rows in bounded batches, and only the first and last product of a
task need joining with their neighbours.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.operators.inventory import forecast_poisson, poisson_forecast

# The coefficient grid, in order of preference on equal fit.
STEPS_OF_TENTHS = np.arange(-9, 10) / 10.0
PHI = np.repeat(STEPS_OF_TENTHS, len(STEPS_OF_TENTHS))
THETA = np.tile(STEPS_OF_TENTHS, len(STEPS_OF_TENTHS))
RATIO = -THETA
FIT_DIGITS = 6
FEWEST_POINTS = 3

PIECE_ROWS = 64


def _decay_squares(length: int) -> np.ndarray:
    """Sum of RATIO**(2*t) for t = 1..length."""
    square = RATIO * RATIO
    return square * (1 - square**length) / (1 - square)


@dataclass
class Stretch:
    """Consecutive values of one product: the first two as they are, the rest summed up
    for a residual of zero at entry (fit, cross, last) over ``length`` values."""

    head: list[float]
    tail: list[float]
    total: float
    count: int
    length: int
    fit: np.ndarray
    cross: np.ndarray
    last: np.ndarray

    @classmethod
    def empty(cls) -> Stretch:
        zero = np.zeros(len(PHI))
        return cls([], [], 0.0, 0, 0, zero, zero, zero)

    def pack(self) -> bytes:
        return pickle.dumps([getattr(self, field.name) for field in fields(self)])

    @classmethod
    def unpack(cls, packed: bytes) -> Stretch:
        return cls(*pickle.loads(packed))

    def extend(self, fit: np.ndarray, cross: np.ndarray, last: np.ndarray, length: int) -> None:
        """Append a summed piece whose predecessor values are those of this stretch."""
        decay, squares = RATIO**self.length, _decay_squares(length)
        self.fit = self.fit + fit + 2 * self.last * cross + self.last**2 * squares
        self.cross = self.cross + decay * (cross + self.last * squares)
        self.last = last + RATIO**length * self.last
        self.length += length


@dataclass
class Fitted:
    count: int
    total: float
    level: float
    step: float
    residual: np.ndarray
    fit: np.ndarray


def join_stretches(stretches: Sequence[Stretch]) -> Fitted:
    """Run the residual through consecutive stretches of one series."""
    state = Fitted(0, 0.0, 0.0, 0.0, np.zeros(len(PHI)), np.zeros(len(PHI)))
    for stretch in stretches:
        for value in stretch.head:
            if state.count:
                step = value - state.level
                state.residual = step - PHI * state.step - THETA * state.residual
                state.fit = state.fit + state.residual**2
                state.step = step
            state.level = value
            state.count += 1
        if stretch.length:
            entry = state.residual
            state.fit = state.fit + stretch.fit + 2 * entry * stretch.cross
            state.fit = state.fit + entry**2 * _decay_squares(stretch.length)
            state.residual = stretch.last + RATIO**stretch.length * entry
            state.level, state.step = stretch.tail[-1], stretch.tail[-1] - stretch.tail[-2]
            state.count += stretch.length
        state.total += stretch.total
    return state


def project(state: Fitted, steps: int) -> int | None:
    if state.count < FEWEST_POINTS:
        return None
    best = int(np.argmin(np.round(state.fit, FIT_DIGITS)))
    phi, theta = PHI[best], THETA[best]
    change = phi * state.step + theta * state.residual[best]
    return int(np.rint(state.level + change * np.sum(phi ** np.arange(steps))))


def _sum_pieces(steps: np.ndarray, before: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Sum up many pieces at once: one numpy step per position, all pieces side by side."""
    order = np.argsort(-sizes, kind="stable")
    ranked, begins = sizes[order], starts[order]
    fit = np.zeros((len(order), len(PHI)))
    cross = np.zeros_like(fit)
    last = np.zeros_like(fit)
    decay = np.ones(len(PHI))
    for position in range(int(ranked[0]) if len(ranked) else 0):
        active = int(np.searchsorted(-ranked, -position, side="left"))
        at = begins[:active] + position
        residual = steps[at, None] - before[at, None] * PHI + last[:active] * RATIO
        decay = decay * RATIO
        fit[:active] += residual * residual
        cross[:active] += residual * decay
        last[:active] = residual
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return fit[back], cross[back], last[back]


def _consume(values: np.ndarray, bounds: np.ndarray, stretches: list[Stretch]) -> None:
    """Add the batch rows ``bounds[i]:bounds[i+1]`` to ``stretches[i]``."""
    carried = stretches[0].tail[-2:]
    series = np.concatenate([carried, values])
    bounds = bounds + len(carried)
    steps = np.diff(series, prepend=np.nan)
    before = np.concatenate([[np.nan], steps[:-1]])
    starts, sizes, owners = [], [], []
    for owner, stretch in enumerate(stretches):
        begin, end = int(bounds[owner]), int(bounds[owner + 1])
        fresh = max(0, min(2 - stretch.count, end - begin))
        stretch.head.extend(series[begin : begin + fresh].tolist())
        stretch.total += float(series[begin:end].sum())
        stretch.count += end - begin
        stretch.tail = (stretch.tail + series[max(begin, end - 2) : end].tolist())[-2:]
        for start in range(begin + fresh, end, PIECE_ROWS):
            starts.append(start)
            sizes.append(min(PIECE_ROWS, end - start))
            owners.append(owner)
    if not starts:
        return
    fit, cross, last = _sum_pieces(steps, before, np.array(starts), np.array(sizes))
    for piece, owner in enumerate(owners):
        stretches[owner].extend(fit[piece], cross[piece], last[piece], sizes[piece])


def _fit_partition(batches: Iterator[pd.DataFrame], steps: int) -> Iterator[pd.DataFrame]:
    """Stream one ordered range partition. Inner products are complete and leave as
    forecasts; the first and the last leave as stretches to be joined."""
    slot = TaskContext.get().partitionId() * 2
    open_key, open_stretch, first = None, None, True

    def unfinished(key, stretch, position):
        return (key, None, None, None, position, stretch.pack())

    for batch in batches:
        if not len(batch):
            continue
        keys = batch["product_id"].to_numpy()
        values = batch["units_sold"].to_numpy(dtype=float)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = np.concatenate([[0], cuts, [len(keys)]])
        run_keys = keys[bounds[:-1]]
        rows = []
        if open_key is not None and run_keys[0] != open_key:
            rows.append((open_key, open_stretch))
            open_stretch = None
        stretches = [Stretch.empty() for _ in run_keys]
        if open_stretch is not None:
            stretches[0] = open_stretch
        _consume(values, bounds, stretches)
        rows.extend(zip(run_keys[:-1], stretches[:-1]))
        open_key, open_stretch = run_keys[-1], stretches[-1]
        out = []
        for key, stretch in rows:
            if first:
                out.append(unfinished(key, stretch, slot))
                first = False
            else:
                state = join_stretches([stretch])
                out.append((key, project(state, steps), state.total, state.count, None, None))
        if out:
            yield _as_frame(out)
    if open_key is not None:
        yield _as_frame([unfinished(open_key, open_stretch, slot + 1)])


def _as_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["product_id", "forecast", "total", "count", "position", "stretch"])
    return frame.astype({"forecast": "Int64", "count": "Int64", "position": "Int64", "total": "Float64"})


def forecast_series(sales: DataFrame, tiebreak: Sequence[str], steps: int = 1) -> DataFrame:
    """Per product: units total, number of points and the ARIMA forecast.

    One range shuffle on (product, date, tiebreak) orders the series and splits hot
    products; the second shuffle moves one row per product and task.
    """
    order = ["product_id", "date", *tiebreak]
    usable = sales.where("product_id IS NOT NULL AND date IS NOT NULL AND units_sold IS NOT NULL")
    ordered = (
        usable.select(*order, "units_sold")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("product_id", F.col("units_sold").cast("double").alias("units_sold"))
    )
    key_type = sales.schema["product_id"].dataType
    schema = T.StructType(
        [
            T.StructField("product_id", key_type),
            T.StructField("forecast", T.LongType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("count", T.LongType()),
            T.StructField("position", T.LongType()),
            T.StructField("stretch", T.BinaryType()),
        ]
    )
    parts = ordered.mapInPandas(lambda batches: _fit_partition(batches, steps), schema)

    @F.pandas_udf("forecast bigint, total double, count bigint")
    def joined(stretches: pd.Series) -> pd.DataFrame:
        rows = []
        for blobs in stretches:
            if blobs is None or not len(blobs):
                rows.append((None, None, None))
                continue
            state = join_stretches([Stretch.unpack(blob) for blob in blobs])
            rows.append((project(state, steps), state.total, state.count))
        frame = pd.DataFrame(rows, columns=["forecast", "total", "count"])
        return frame.astype({"forecast": "Int64", "total": "Float64", "count": "Int64"})

    open_parts = F.sort_array(
        F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "stretch")))
    )
    grouped = parts.groupBy("product_id").agg(
        F.max("forecast").alias("forecast"),
        F.max("total").alias("total"),
        F.max("count").alias("count"),
        F.transform(open_parts, lambda part: part["stretch"]).alias("stretches"),
    )
    merged = grouped.withColumn("joined", joined("stretches"))
    pick = {name: F.coalesce(f"joined.{name}", name).alias(name) for name in ("forecast", "total", "count")}
    return merged.select("product_id", *pick.values())


def forecast_arima(sales: DataFrame, tiebreak: Sequence[str], steps: int = 1) -> DataFrame:
    """ARIMA forecast ``steps`` ahead; NULL with fewer than three points."""
    fitted = forecast_series(sales, tiebreak, steps)
    return fitted.select("product_id", F.col("forecast").alias("arima_forecast"))


def forecast_demand(sales: DataFrame, tiebreak: Sequence[str], model: str = "both", steps: int = 1) -> DataFrame:
    """Poisson, ARIMA or both forecasts per product. Both: every product with a row, its name,
    the Poisson forecast over all of its rows, and the ARIMA forecast of its dated series, NULL
    where that is too short."""
    if model == "poisson":
        return forecast_poisson(sales)
    if model == "arima":
        return forecast_arima(sales, tiebreak, steps)
    if model != "both":
        raise ValueError(f"unknown model: {model}")
    named = [F.max("product_name").alias("product_name")] if "product_name" in sales.columns else []
    means = (
        sales.where("product_id IS NOT NULL")
        .groupBy("product_id")
        .agg(*named, poisson_forecast(F.col("units_sold")).alias("poisson_forecast"))
    )
    return means.join(forecast_arima(sales, tiebreak, steps), "product_id", "left")

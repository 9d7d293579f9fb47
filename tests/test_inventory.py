import datetime as dt
import random

import numpy as np
import pytest

from tallyquill.operators import arima, inventory

SCHEMA = "date date, product_id bigint, product_name string, warehouse string, units_sold double, stock bigint, seq int"
DAY = dt.date(2024, 1, 1)


def sales(spark, *rows):
    full = [
        (DAY + dt.timedelta(days=day) if day is not None else None, p, f"name {p}", w, units, stock, i)
        for i, (day, p, w, units, stock) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def test_half_even_and_strict_comparison(spark):
    frame = sales(spark, (0, 1, "A", 2.0, 9), (1, 1, "A", 3.0, 2), (0, 2, "A", 5.0, None), (0, 3, "A", 4.0, 5), (1, 3, "A", 6.0, None))
    rows = {r.product_id: r for r in inventory.replenishment(frame, ["seq"]).collect()}
    assert (rows[1].poisson_forecast, rows[1].stock, rows[1].restock_needed) == (2, 2, False)
    assert (rows[2].stock, rows[2].restock_needed, rows[2].status) == (None, False, inventory.STOCK_OK)
    assert (rows[3].stock, rows[3].restock_needed) == (5, False)


def test_undated_rows_never_win(spark):
    frame = sales(spark, (None, 1, "A", 1.0, 99), (0, 1, "A", 1.0, 5), (None, 2, "A", 1.0, 7))
    assert [tuple(r) for r in inventory.latest_stock(frame, ["seq"]).collect()] == [(1, 5)]
    assert [r.product_id for r in inventory.replenishment(frame, ["seq"]).collect()] == [1]


def test_null_keys_and_null_sums(spark):
    frame = sales(spark, (0, None, "A", 1.0, 1), (0, 1, None, 1.0, 1), (0, 1, "A", None, 1))
    assert [tuple(r) for r in inventory.demand(frame).collect()] == [(1, "A", 0.0)]
    assert inventory.demand_share(frame).first()["share"] is None


def dims(spark):
    warehouses = spark.createDataFrame([("A", 200.0, 2), ("B", 150.0, 1), ("C", 50.0, 1)], "warehouse string, capacity double, lead_days int")
    products = spark.createDataFrame([(1, 100), (2, 60)], "product_id bigint, total_stock int")
    return warehouses, products


def test_allocation_by_hand(spark):
    warehouses, products = dims(spark)
    frame = sales(spark, (0, 1, "A", 30.0, 1), (0, 1, "B", 10.0, 1), (0, 2, "B", 5.0, 1))
    weights = {(r.product_id, r.warehouse): r.weight for r in inventory.allocation_weights(frame, warehouses).collect()}
    assert weights[1, "A"] == pytest.approx(0.75 * 0.5 * 0.5)
    assert weights[1, "B"] == pytest.approx(0.25 * 0.375)
    found = {(r.product_id, r.warehouse): r.allocation for r in inventory.allocate(frame, warehouses, products).collect()}
    assert found == {(1, "A"): 66.7, (1, "B"): 33.3, (2, "B"): 60.0}


def test_allocations_sum_to_stock_and_report_gaps(spark):
    warehouses, products = dims(spark)
    rng = random.Random(1)
    frame = sales(spark, *((0, rng.choice([1, 2, 3]), rng.choice("ABCD"), float(rng.randint(1, 9)), 1) for _ in range(60)))
    totals = {r[0]: r[1] for r in inventory.allocate(frame, warehouses, products, 6).groupBy("product_id").sum("allocation").collect()}
    assert totals == {1: pytest.approx(100), 2: pytest.approx(60)}
    missing = {tuple(r) for r in inventory.unmatched_dimensions(frame, warehouses, products).collect()}
    assert missing == {("warehouse", "D"), ("product", "3")}


def test_running_stock_over_many_slabs(spark):
    rng = random.Random(2)
    rows = [(DAY + dt.timedelta(days=rng.randint(0, 400)), 1 if rng.random() < 0.8 else 2, "A", rng.randint(-5, 5), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "date date, product_id bigint, warehouse string, delta bigint, seq int")
    found = {r.seq: r.on_hand for r in inventory.running_stock(frame, ["seq"], slab_days=7).collect()}
    held = {1: 0, 2: 0}
    for date, product, _, delta, seq in sorted(rows, key=lambda r: (r[0], r[4])):
        held[product] += delta
        assert found[seq] == held[product]
    assert len(found) == 400


def test_history_shapes(spark):
    rows = [(i, f"n{i}", 1, 2, DAY + dt.timedelta(days=i % 7)) for i in range(150)]
    history = spark.createDataFrame(rows, "product_id bigint, product_name string, poisson_forecast bigint, arima_forecast bigint, created_at date")
    recent = [(r.created_at, r.product_id) for r in inventory.recent_history(history).collect()]
    newest = sorted(((r[4], -r[0]) for r in rows), reverse=True)[:100]
    assert recent == sorted((d, -p) for d, p in newest)
    assert inventory.history_long(history).count() == 300
    assert inventory.stacked_forecasts(history).first()["stack_top"] == 3


# --- ARIMA ----------------------------------------------------------------------------


def brute_force(values, steps=1):
    if len(values) < 3:
        return None
    best = None
    d = np.diff(values)
    for phi in arima.STEPS_OF_TENTHS:
        for theta in arima.STEPS_OF_TENTHS:
            error, previous, fit = 0.0, 0.0, 0.0
            for change in d:
                error = change - phi * previous - theta * error
                previous = change
                fit += error * error
            change = phi * d[-1] + theta * error
            forecast = values[-1] + change * sum(phi**j for j in range(steps))
            key = (round(fit, 6), phi, theta)
            if best is None or key < best[0]:
                best = (key, forecast)
    return int(np.rint(best[1]))


def series_frame(spark, series):
    rows = [(DAY + dt.timedelta(days=i), p, "n", "A", float(v), 1, i) for p, values in series.items() for i, v in enumerate(values)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("steps", [1, 3])
def test_arima_equals_brute_force(spark, steps):
    rng = random.Random(steps)
    series = {p: [rng.randint(0, 60) for _ in range(n)] for p, n in enumerate([1, 2, 3, 4, 5, 30, 64, 65, 66, 67, 130, 200])}
    found = {r.product_id: r.arima_forecast for r in arima.forecast_arima(series_frame(spark, series), ["seq"], steps).collect()}
    assert found == {p: brute_force(values, steps) for p, values in series.items()}


def test_arima_of_a_product_with_most_rows(spark):
    """The hot product spans range partitions and Arrow batches."""
    rng = random.Random(5)
    series = {1: [rng.randint(0, 9) for _ in range(1500)], **{p: [rng.randint(0, 9) for _ in range(8)] for p in range(2, 60)}}
    frame = series_frame(spark, series)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        both = {r.product_id: r for r in arima.forecast_demand(frame, ["seq"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {p: r.arima_forecast for p, r in both.items()} == {p: brute_force(v) for p, v in series.items()}
    assert {p: r.poisson_forecast for p, r in both.items()} == {p: round(np.mean(v)) for p, v in series.items()}


@pytest.mark.parametrize("cuts", [[], [1], [2], [3], [1, 2, 3], [5, 50], [10, 11, 12, 90]])
def test_stretches_join_anywhere(cuts):
    rng = random.Random(7)
    values = np.array([rng.randint(0, 50) for _ in range(100)], dtype=float)
    whole = arima.Stretch.empty()
    arima._consume(values, np.array([0, 100]), [whole])
    parts = []
    for begin, end in zip([0, *cuts], [*cuts, 100]):
        stretch = arima.Stretch.empty()
        arima._consume(values[begin:end], np.array([0, end - begin]), [stretch])
        parts.append(arima.Stretch.unpack(stretch.pack()))
    one, many = arima.join_stretches([whole]), arima.join_stretches(parts)
    assert many.count == one.count == 100 and many.total == one.total
    np.testing.assert_allclose(many.fit, one.fit)
    np.testing.assert_allclose(many.residual, one.residual, atol=1e-9)


def test_forecast_models(spark):
    frame = sales(spark, (0, 1, "A", 2.0, 9), (1, 1, "A", 3.0, 2))
    assert arima.forecast_demand(frame, ["seq"], "poisson").columns == ["product_id", "poisson_forecast"]
    assert arima.forecast_demand(frame, ["seq"], "arima").columns == ["product_id", "arima_forecast"]
    with pytest.raises(ValueError):
        arima.forecast_demand(frame, ["seq"], "other")


def test_both_forecasts_keep_every_product(spark):
    """Rows without a date count for the mean; a product without units has a row."""
    frame = sales(spark, (0, 1, "A", 10.0, 1), (1, 1, "A", 12.0, 1), (2, 1, "A", 11.0, 1), (None, 1, "A", 1000.0, 1), (3, 2, "A", None, 1))
    rows = {r.product_id: (r.poisson_forecast, r.arima_forecast is None) for r in arima.forecast_demand(frame, ["seq"]).collect()}
    assert rows == {1: (258, False), 2: (None, True)}


def test_matrix_shows_warehouses_that_are_not_listed(spark):
    frame = sales(spark, (0, 1, "w1", 2.0, 1), (1, 1, "w9", 7.0, 1))
    dim = spark.createDataFrame([("w1",), (None,)], "warehouse string")
    row = inventory.demand_matrix(frame, inventory.warehouse_names(dim)).first()
    assert (row["w1"], row["unlisted"]) == (2.0, 7.0)

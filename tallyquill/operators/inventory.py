"""Sales and stock operators. Sales rows: date, product_id, product_name, warehouse,
units_sold, stock, plus the columns that break ties within a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyquill.session import bounded_table

# Alert threshold, history length and status texts of the dashboard.
LOW_STOCK = 50
HISTORY_ROWS = 100
RESTOCK_NEEDED = "🚨 Restock Needed"
STOCK_OK = "✅ Stock OK"


def demand(sales: DataFrame) -> DataFrame:
    """Units per product and warehouse; null keys are dropped, all-null sums are 0."""
    keyed = sales.where(F.col("product_id").isNotNull() & F.col("warehouse").isNotNull())
    return keyed.groupBy("product_id", "warehouse").agg(
        F.coalesce(F.sum("units_sold"), F.lit(0.0)).alias("units")
    )


def warehouse_names(warehouse_dim: DataFrame, most: int = 1_000) -> list[str]:
    """Names of the dimension, which become columns; more than ``most`` are refused."""
    names = bounded_table(warehouse_dim.select("warehouse").where("warehouse IS NOT NULL").distinct(), most)
    return sorted(names.column(0).to_pylist())


def demand_matrix(sales: DataFrame, warehouses: Sequence[str]) -> DataFrame:
    """One row per product and one 0-filled column per listed warehouse.

    Warehouses are the columns because their list is short and known, from the dimension
    table; products, which grow with the data, stay rows. ``unlisted`` has the demand of
    warehouses that are not in the list.
    """
    listed = list(warehouses)
    rows = demand(sales)
    other = F.sum(F.when(~F.col("warehouse").isin(listed), F.col("units")))
    sums = [F.sum(F.when(F.col("warehouse") == w, F.col("units"))).alias(w) for w in listed]
    wide = rows.groupBy("product_id").agg(*sums, other.alias("unlisted"))
    return wide.fillna(0.0, subset=[*listed, "unlisted"])


def demand_share(sales: DataFrame) -> DataFrame:
    """Part of a product's demand that falls on each warehouse; NULL for zero demand."""
    total = F.sum("units").over(W.partitionBy("product_id"))
    return demand(sales).withColumn("share", F.try_divide("units", total))


def allocation_weights(sales: DataFrame, warehouse_dim: DataFrame) -> DataFrame:
    """Share x capacity part x inverse lead time. Capacity is taken over all listed
    warehouses, whether or not they sold anything."""
    total_capacity = warehouse_dim.agg(F.sum("capacity")).scalar()
    factors = warehouse_dim.select(
        "warehouse",
        (F.try_divide("capacity", total_capacity) * F.try_divide(F.lit(1.0), "lead_days")).alias("factor"),
    )
    return (
        demand_share(sales)
        .join(factors, "warehouse")
        .select("product_id", "warehouse", "units", "share", (F.col("share") * F.col("factor")).alias("weight"))
    )


def allocate(sales: DataFrame, warehouse_dim: DataFrame, product_dim: DataFrame, digits: int = 1) -> DataFrame:
    """Split each product's total stock over warehouses in proportion to the weights.

    The amount is first rounded to nine digits, so that the order in which weights are
    summed cannot tip an exact half.
    """
    total = F.sum("weight").over(W.partitionBy("product_id"))
    return (
        allocation_weights(sales, warehouse_dim)
        .withColumn("part", F.try_divide("weight", total))
        .join(product_dim, "product_id")
        .select(
            "product_id",
            "warehouse",
            F.bround(F.round(F.col("part") * F.col("total_stock"), 9), digits).alias("allocation"),
        )
    )


def unmatched_dimensions(sales: DataFrame, warehouse_dim: DataFrame, product_dim: DataFrame) -> DataFrame:
    """Warehouses and products that sold but are missing from a dimension table."""
    sold = sales.select("product_id", "warehouse")
    warehouses = (
        sold.select("warehouse").where("warehouse IS NOT NULL").distinct()
        .join(warehouse_dim, "warehouse", "left_anti")
        .select(F.lit("warehouse").alias("dimension"), F.col("warehouse").cast("string").alias("key"))
    )
    products = (
        sold.select("product_id").where("product_id IS NOT NULL").distinct()
        .join(product_dim, "product_id", "left_anti")
        .select(F.lit("product").alias("dimension"), F.col("product_id").cast("string").alias("key"))
    )
    return warehouses.unionByName(products)


def poisson_forecast(units: Column) -> Column:
    """Mean of the units, rounded half to even."""
    return F.bround(F.avg(units)).cast("bigint")


def forecast_poisson(sales: DataFrame) -> DataFrame:
    return (
        sales.where("product_id IS NOT NULL")
        .groupBy("product_id")
        .agg(poisson_forecast(F.col("units_sold")).alias("poisson_forecast"))
    )


def _last_stock(order: Sequence[str]) -> Column:
    usable = F.col("date").isNotNull() & F.col("stock").isNotNull()
    key = F.when(usable, F.struct("date", *order))
    return F.max_by(F.col("stock"), key)


def latest_stock(sales: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """Last non-null stock of each product by date; rows without a date never win."""
    return (
        sales.where("product_id IS NOT NULL AND date IS NOT NULL")
        .groupBy("product_id")
        .agg(_last_stock(tiebreak).alias("stock"))
    )


def replenishment(sales: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """Flag products whose forecast exceeds their latest stock.

    Forecast and stock are aggregates of the same rows by the same key, so one
    partial and one final aggregation replace the join of two results.
    """
    dated = F.count("date") > 0
    per_product = (
        sales.where("product_id IS NOT NULL")
        .groupBy("product_id")
        .agg(
            F.max("product_name").alias("product_name"),
            poisson_forecast(F.col("units_sold")).alias("poisson_forecast"),
            _last_stock(tiebreak).alias("stock"),
            dated.alias("dated"),
        )
        .where("dated")
        .drop("dated")
    )
    needed = F.coalesce(F.col("poisson_forecast") > F.col("stock"), F.lit(False))
    return per_product.withColumn("restock_needed", needed).withColumn(
        "status", F.when(needed, RESTOCK_NEEDED).otherwise(STOCK_OK)
    )


def inventory_state(sales: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """Stock per product and warehouse after all upserts, in order of arrival."""
    usable = F.col("date").isNotNull() & F.col("stock").isNotNull()
    return (
        sales.where(usable & F.col("product_id").isNotNull() & F.col("warehouse").isNotNull())
        .groupBy("product_id", "warehouse")
        .agg(
            F.max("product_name").alias("product_name"),
            F.max_by("stock", F.struct("date", *tiebreak)).alias("stock"),
            F.max("date").alias("last_updated"),
        )
        .select("product_id", "product_name", "warehouse", "stock", "last_updated")
    )


def read_inventory(inventory: DataFrame, warehouse: str | None = None) -> DataFrame:
    """All rows, or those of one warehouse; the equality reaches the scan."""
    return inventory if not warehouse else inventory.where(F.col("warehouse") == warehouse)


def low_stock(inventory: DataFrame, threshold: int = LOW_STOCK) -> DataFrame:
    return inventory.where(F.col("stock") < threshold)


def recent_history(history: DataFrame, rows: int = HISTORY_ROWS, key: str = "product_id") -> DataFrame:
    """The newest rows, shown oldest first."""
    return history.orderBy(F.col("created_at").desc(), key).limit(rows).orderBy("created_at", key)


def history_long(history: DataFrame) -> DataFrame:
    """One row per series point, as a trend chart needs it."""
    return history.unpivot(
        ["created_at", "product_id", "product_name"],
        ["poisson_forecast", "arima_forecast"],
        "variable",
        "value",
    )


def stacked_forecasts(forecasts: DataFrame) -> DataFrame:
    """Start and end of both bars when the second forecast is stacked on the first."""
    return forecasts.withColumn("stack_base", F.col("poisson_forecast")).withColumn(
        "stack_top", F.col("poisson_forecast") + F.col("arima_forecast")
    )


def running_stock(movements: DataFrame, order: Sequence[str], slab_days: int = 30) -> DataFrame:
    """Running sum of ``delta`` per product and warehouse in order of ``date``.

    A single window per key would put a hot key into one task. Here the key is cut
    into slabs of days: each slab is summed on its own, and the totals of earlier slabs,
    one row per key and slab, give the amount it starts from.
    """
    key = ["product_id", "warehouse"]
    slabbed = movements.withColumn(
        "slab", F.floor(F.unix_date("date") / F.lit(slab_days)).cast("bigint")
    )
    earlier = W.partitionBy(*key).orderBy("slab").rowsBetween(W.unboundedPreceding, -1)
    opening = (
        slabbed.groupBy(*key, "slab")
        .agg(F.sum("delta").alias("slab_delta"))
        .withColumn("opening", F.coalesce(F.sum("slab_delta").over(earlier), F.lit(0)))
        .drop("slab_delta")
    )
    inside = W.partitionBy(*key, "slab").orderBy("date", *order).rowsBetween(W.unboundedPreceding, 0)
    return (
        slabbed.withColumn("inside", F.sum("delta").over(inside))
        .join(opening, [*key, "slab"])
        .withColumn("on_hand", F.col("opening") + F.col("inside"))
        .drop("slab", "opening", "inside")
    )

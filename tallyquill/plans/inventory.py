"""Registered queries on sales and stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyquill.operators import arima, inventory
from tallyquill.plans import tables as t
from tallyquill.plans.registry import Registry, with_

register = Registry()

S = t.SALES_SQL
DEMAND = """demand AS (SELECT product_id, warehouse, coalesce(sum(units_sold), 0) AS units
  FROM sales WHERE product_id IS NOT NULL AND warehouse IS NOT NULL GROUP BY ALL)"""
SHARE = """shares AS (SELECT *, units / nullif(sum(units) OVER (PARTITION BY product_id), 0) AS share FROM demand)"""
WEIGHT = """weights AS (SELECT product_id, warehouse, units, share,
  share * ((capacity / (SELECT sum(capacity) FROM warehouse_dim)) * (1.0::DOUBLE / lead_days)) AS weight
  FROM shares JOIN warehouse_dim USING (warehouse))"""
REPLENISH = f"""replenish AS (SELECT product_id, max(product_name) AS product_name,
  CAST(round_even(avg(units_sold), 0) AS BIGINT) AS poisson_forecast,
  arg_max(stock, ROW({t.TIE_SQL})) AS stock FROM sales GROUP BY product_id)"""
STATE = f"""inventory AS (SELECT product_id, max(product_name) AS product_name, warehouse,
  arg_max(stock, ROW({t.TIE_SQL})) AS stock, max(date) AS last_updated
  FROM sales GROUP BY product_id, warehouse)"""


@register(
    "replenishment",
    with_(S, REPLENISH)
    + """SELECT product_id, product_name, poisson_forecast, stock,
    poisson_forecast > stock AS restock_needed,
    CASE WHEN poisson_forecast > stock THEN '🚨 Restock Needed' ELSE '✅ Stock OK' END AS status
    FROM replenish""",
)
def replenishment(spark, sf_dir):
    return inventory.replenishment(t.sales(spark, sf_dir), t.TIEBREAK)


@register("demand_by_product_warehouse", with_(S, DEMAND) + "SELECT * FROM demand")
def demand_by_product_warehouse(spark, sf_dir):
    return inventory.demand(t.sales(spark, sf_dir))


# Warehouses of the dimension below, for the SQL only.
WAREHOUSES = ("AFRICA", "AMERICA", "ASIA", "EUROPE")


@register(
    "demand_matrix",
    with_(S, DEMAND)
    + "SELECT product_id, "
    + ", ".join(
        f"""coalesce(sum(units) FILTER (WHERE warehouse = '{w}'), 0) AS "{w}" """ for w in WAREHOUSES
    )
    + ", coalesce(sum(units) FILTER (WHERE warehouse NOT IN ('"
    + "', '".join(WAREHOUSES)
    + "')), 0) AS unlisted FROM demand GROUP BY product_id",
)
def demand_matrix(spark, sf_dir):
    """A dimension without one of the warehouses that sell."""
    dim = t.warehouse_dim(spark, sf_dir).where("warehouse <> 'MIDDLE EAST'")
    return inventory.demand_matrix(t.sales(spark, sf_dir), inventory.warehouse_names(dim))


@register(
    "demand_share",
    with_(S, DEMAND, SHARE) + "SELECT * FROM shares",
)
def demand_share(spark, sf_dir):
    return inventory.demand_share(t.sales(spark, sf_dir))


@register(
    "allocation_weights",
    with_(S, DEMAND, SHARE, t.WAREHOUSE_SQL, WEIGHT)
    + "SELECT * FROM weights",
)
def allocation_weights(spark, sf_dir):
    return inventory.allocation_weights(t.sales(spark, sf_dir), t.warehouse_dim(spark, sf_dir))


ALLOCATE = """SELECT product_id, warehouse, round_even(round(part * total_stock, 9), 1) AS allocation FROM (
  SELECT *, weight / nullif(sum(weight) OVER (PARTITION BY product_id), 0) AS part FROM weights)
  JOIN product_dim USING (product_id)"""


@register(
    "allocate_inventory",
    with_(S, DEMAND, SHARE, t.WAREHOUSE_SQL, WEIGHT, t.PRODUCT_SQL) + ALLOCATE,
)
def allocate_inventory(spark, sf_dir):
    return inventory.allocate(
        t.sales(spark, sf_dir), t.warehouse_dim(spark, sf_dir), t.product_dim(spark, sf_dir)
    )


@register(
    "unmatched_dimensions",
    with_(S)
    + """SELECT DISTINCT 'warehouse' AS dimension, warehouse AS key FROM sales WHERE warehouse <> 'ASIA'
    UNION ALL SELECT DISTINCT 'product', CAST(product_id AS VARCHAR) FROM sales
    WHERE product_id IN (SELECT p_partkey FROM part WHERE p_size >= 10)""",
)
def unmatched_dimensions(spark, sf_dir):
    dims = t.warehouse_dim(spark, sf_dir).where("warehouse = 'ASIA'")
    products = t.product_dim(spark, sf_dir).where("total_stock < 60")
    return inventory.unmatched_dimensions(t.sales(spark, sf_dir), dims, products)


@register(
    "forecast_poisson",
    with_(S)
    + """SELECT product_id, CAST(round_even(avg(units_sold), 0) AS BIGINT) AS poisson_forecast
    FROM sales GROUP BY product_id""",
)
def forecast_poisson(spark, sf_dir):
    return inventory.forecast_poisson(t.sales(spark, sf_dir))


ARIMA_CTES = (
    S,
    f"""series AS (SELECT product_id, list(units_sold ORDER BY {t.TIE_SQL}) AS y,
      avg(units_sold) AS mean FROM sales GROUP BY product_id)""",
    """points AS (SELECT product_id, y, mean, len(y) AS n,
      [{'d': y[i + 1] - y[i], 'b': CASE WHEN i > 1 THEN y[i] - y[i - 1] ELSE 0 END, 'e': 0.0::DOUBLE, 's': 0.0::DOUBLE}
       for i in range(1, len(y))] AS steps FROM series)""",
    "grid AS (SELECT a.i / 10.0::DOUBLE AS phi, b.i / 10.0::DOUBLE AS theta FROM range(-9, 10) a(i), range(-9, 10) b(i))",
    """fits AS (SELECT product_id, y, n, mean, phi, theta, list_reduce(steps, lambda p, q: {
        'd': q.d, 'b': q.b, 'e': q.d - phi * q.b - theta * p.e,
        's': p.s + (q.d - phi * q.b - theta * p.e) * (q.d - phi * q.b - theta * p.e)},
        {'d': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 's': 0.0::DOUBLE}) AS f
      FROM points, grid WHERE n >= 3)""",
    """best AS (SELECT product_id, arg_min(CAST(round_even(y[n] + phi * f.d + theta * f.e, 0) AS BIGINT),
        ROW(round(f.s, 6), phi, theta)) AS arima_forecast FROM fits GROUP BY product_id)""",
)


@register(
    "forecast_arima",
    with_(*ARIMA_CTES) + "SELECT product_id, arima_forecast FROM points LEFT JOIN best USING (product_id)",
)
def forecast_arima(spark, sf_dir):
    return arima.forecast_arima(t.sales(spark, sf_dir), t.TIEBREAK)


GAPPY = """gappy AS (SELECT * REPLACE (CASE WHEN l_orderkey % 7 <> 0 THEN date END AS date,
    CASE WHEN product_id % 50 <> 0 THEN units_sold END AS units_sold) FROM base)"""
DATED = "sales AS (SELECT * FROM gappy WHERE date IS NOT NULL AND units_sold IS NOT NULL)"


@register(
    "forecast_demand",
    with_(S.replace("sales AS", "base AS", 1), GAPPY, DATED, *ARIMA_CTES[1:])
    + """SELECT product_id, max(g.product_name) AS product_name,
    CAST(round_even(avg(g.units_sold), 0) AS BIGINT) AS poisson_forecast, any_value(arima_forecast) AS arima_forecast
    FROM gappy g LEFT JOIN best USING (product_id) GROUP BY product_id""",
)
def forecast_demand(spark, sf_dir):
    """Some sales have no date, some products no units."""
    dated = F.when(F.col("l_orderkey") % 7 != 0, F.col("date"))
    counted = F.when(F.col("product_id") % 50 != 0, F.col("units_sold"))
    rows = t.sales(spark, sf_dir).withColumn("date", dated).withColumn("units_sold", counted)
    return arima.forecast_demand(rows, t.TIEBREAK)


@register(
    "latest_stock",
    with_(S, REPLENISH) + "SELECT product_id, stock FROM replenish",
)
def latest_stock(spark, sf_dir):
    return inventory.latest_stock(t.sales(spark, sf_dir), t.TIEBREAK)


@register("inventory_state", with_(S, STATE) + "SELECT * FROM inventory")
def inventory_state(spark, sf_dir):
    return inventory.inventory_state(t.sales(spark, sf_dir), t.TIEBREAK)


@register("inventory_read", with_(S, STATE) + "SELECT * FROM inventory WHERE warehouse = 'ASIA'")
def inventory_read(spark, sf_dir):
    return inventory.read_inventory(inventory_state(spark, sf_dir), "ASIA")


@register("low_stock", with_(S, STATE) + "SELECT * FROM inventory WHERE stock < 50")
def low_stock(spark, sf_dir):
    return inventory.low_stock(inventory_state(spark, sf_dir))


@register(
    "forecast_history_recent",
    with_(S, t.HISTORY_SQL)
    + "SELECT * FROM (SELECT * FROM history ORDER BY created_at DESC, product_id LIMIT 100) ORDER BY created_at",
)
def forecast_history_recent(spark, sf_dir):
    return inventory.recent_history(t.forecast_history(spark, sf_dir))


@register(
    "forecast_history_long",
    with_(S, t.HISTORY_SQL)
    + """SELECT created_at, product_id, product_name, 'poisson_forecast' AS variable, poisson_forecast AS value FROM history
    UNION ALL SELECT created_at, product_id, product_name, 'arima_forecast', arima_forecast FROM history""",
)
def forecast_history_long(spark, sf_dir):
    return inventory.history_long(t.forecast_history(spark, sf_dir))


@register(
    "forecast_stacked",
    with_(S, t.HISTORY_SQL)
    + "SELECT *, poisson_forecast AS stack_base, poisson_forecast + arima_forecast AS stack_top FROM history",
)
def forecast_stacked(spark, sf_dir):
    return inventory.stacked_forecasts(t.forecast_history(spark, sf_dir))


MOVEMENT_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "delta")


@register(
    "inventory_live_update",
    with_(
        S,
        """movements AS (SELECT product_id, warehouse, date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
        CAST(CASE WHEN l_orderkey % 3 = 0 THEN units_sold ELSE -units_sold END AS BIGINT) AS delta FROM sales)""",
    )
    + """SELECT *, CAST(sum(delta) OVER (PARTITION BY product_id, warehouse
      ORDER BY date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, delta
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS on_hand FROM movements""",
)
def inventory_live_update(spark, sf_dir):
    return inventory.running_stock(movements(spark, sf_dir), MOVEMENT_ORDER)


def movements(spark, sf_dir):
    """Every third order adds to the stock, the others take from it."""
    sold = F.when(F.col("l_orderkey") % 3 == 0, F.col("units_sold")).otherwise(-F.col("units_sold"))
    return t.sales(spark, sf_dir).select(
        "product_id", "warehouse", "date", *MOVEMENT_ORDER[:-1], sold.cast("bigint").alias("delta")
    )

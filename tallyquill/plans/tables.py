"""The given tables, and the shapes the operators work on derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIEBREAK = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "units_sold")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows over as many tasks as the session setting ``spark.tallyquill.spread`` says,
    for tables that are one split; without the setting a scan keeps its splits."""
    tasks = rows.sparkSession.conf.get("spark.tallyquill.spread", None)
    return rows.repartition(int(tasks)) if tasks else rows


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sales: part = product, supplier's region = warehouse."""
    products = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("product_name"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(products, F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_partkey").alias("product_id"),
            "product_name",
            F.col("r_name").alias("warehouse"),
            F.col("l_quantity").alias("units_sold"),
            ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 60).cast("bigint").alias("stock"),
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
            "l_extendedprice",
        )
    )


SALES_SQL = """sales AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS product_id, p_name AS product_name,
         r_name AS warehouse, l_quantity AS units_sold,
         CAST((l_orderkey * 7 + l_linenumber) % 60 AS BIGINT) AS stock,
         l_orderkey, l_linenumber, l_suppkey, l_extendedprice
  FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""

TIE_SQL = "date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, units_sold"


def warehouse_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("warehouse"),
        (F.lit(100.0) + 50 * F.col("r_regionkey")).alias("capacity"),
        (1 + F.col("r_regionkey") % 3).alias("lead_days"),
    )


WAREHOUSE_SQL = """warehouse_dim AS (
  SELECT r_name AS warehouse, 100.0::DOUBLE + 50 * r_regionkey AS capacity,
         1 + r_regionkey % 3 AS lead_days FROM region)"""


def product_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), (F.lit(50) + F.col("p_size")).alias("total_stock")
    )


PRODUCT_SQL = "product_dim AS (SELECT p_partkey AS product_id, 50 + p_size AS total_stock FROM part)"


def forecast_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product and month: rounded mean, and the month's last units as the
    second forecast."""
    rows = sales(spark, sf_dir)
    return (
        rows.groupBy("product_id", F.date_trunc("month", "date").alias("created_at"))
        .agg(
            F.max("product_name").alias("product_name"),
            F.bround(F.avg("units_sold")).cast("bigint").alias("poisson_forecast"),
            F.max_by("units_sold", F.struct("date", *TIEBREAK)).cast("bigint").alias("arima_forecast"),
        )
        .withColumn("created_at", F.to_date("created_at"))
        .select("product_id", "product_name", "poisson_forecast", "arima_forecast", "created_at")
    )


HISTORY_SQL = f"""history AS (
  SELECT product_id, max(product_name) AS product_name,
         CAST(round_even(avg(units_sold), 0) AS BIGINT) AS poisson_forecast,
         CAST(arg_max(units_sold, ROW({TIE_SQL})) AS BIGINT) AS arima_forecast,
         CAST(date_trunc('month', date) AS DATE) AS created_at
  FROM sales GROUP BY product_id, CAST(date_trunc('month', date) AS DATE))"""

"""Readers and writers of tables. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The sales file.
SALES_SCHEMA = (
    "date DATE, product_id BIGINT, product_name STRING, warehouse STRING, units_sold DOUBLE, stock BIGINT"
)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_sales(spark: SparkSession, path: str, schema: str = SALES_SCHEMA) -> DataFrame:
    """Sales rows with typed dates."""
    return read_csv(spark, path, schema)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; filters on the result are pushed into the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks as one table, partitioned by strategy instead of one file per chunk."""
    chunks.write.mode(mode).partitionBy("chunk_type").parquet(path)


def export_json(store: DataFrame, collection: str, path: str) -> None:
    """A collection as JSON lines, one object per chunk."""
    chosen = store.where(F.col("collection") == collection)
    chosen.select("id", "text", "source", "embedding").write.json(path)


def audit_rows(module: str, result: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One JSON record per result row under the module's name."""
    columns = list(order or result.columns)
    return result.select(F.lit(module).alias("module"), F.to_json(F.struct(*columns)).alias("data"))


def append_audit(module: str, result: DataFrame, path: str) -> None:
    stamped = audit_rows(module, result).withColumn("logged_at", F.current_timestamp())
    stamped.write.mode("append").partitionBy("module").parquet(path)


def append_history(forecasts: DataFrame, path: str, created_at: Column | None = None) -> None:
    """Add one row per product to the forecast history, partitioned by year."""
    stamp = F.current_timestamp() if created_at is None else created_at
    stamped = forecasts.withColumn("created_at", stamp)
    stamped.withColumn("created_year", F.year("created_at")).write.mode("append").partitionBy("created_year").parquet(path)


def read_malformed(spark: SparkSession, path: str, schema: str = SALES_SCHEMA) -> DataFrame:
    """The lines of a sales file that do not fit the schema, as they are."""
    corrupt = "malformed"
    reader = spark.read.schema(f"{schema}, {corrupt} STRING").option("header", "true")
    rows = reader.option("columnNameOfCorruptRecord", corrupt).csv(path)
    return rows.where(F.col(corrupt).isNotNull())

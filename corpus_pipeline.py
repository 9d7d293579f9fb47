"""The corpus pipeline: documents to a deduplicated, clean, weighted and sharded mix.

Each stage is one of the library's training-data operators. Its result is written as Parquet and
read again as the next stage's input, so that every stage can be repeated by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyquill.llm import decontamination, mixing, near_dedup, quality_rules, queries, sharding
from tallyquill.plans.tables import spread
from tallyquill.session import written

SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(spread(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep(spread(docs), size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontamination.drop(spread(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that sources come near their target weights."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard."""
    return sharding.place(docs, SHARDS)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = f"""WITH RECURSIVE {queries.rule_sql()},
good AS MATERIALIZED (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM judged WHERE kept)),
{queries.near_sql("good", 5, 80)},
single AS MATERIALIZED (SELECT * FROM good WHERE doc_id IN (SELECT doc_id FROM near WHERE kept)),
{queries.leak_sql("single")},
clean AS MATERIALIZED (SELECT * FROM single WHERE doc_id IN (SELECT doc_id FROM leaks WHERE NOT contaminated)),
{queries.mix_sql("clean")},
dealt AS (SELECT doc_id FROM clean),
{queries.jump_sql(SHARDS, "dealt")}
SELECT c.*, d.b::INTEGER AS shard
FROM (SELECT doc_id, unnest(range(copies)) FROM mixed) m JOIN clean c USING (doc_id)
JOIN dealt_{SHARDS} d USING (doc_id)"""

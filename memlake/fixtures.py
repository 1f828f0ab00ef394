"""The record view over the synthetic tables (documents + labels).

Every registered query reads this view, so its work grows with the input
tables.  The mapping is fixed so Spark and the DuckDB oracle build the same
rows: source and category come from ``doc_id`` residues, tags are the
document's language and source columns, ``sensitive`` is the ``toxic`` label.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the view.
VIEW_EPOCH = _dt.datetime(2024, 1, 1, tzinfo=_dt.timezone.utc)
AS_OF = _dt.datetime(2024, 7, 20, tzinfo=_dt.timezone.utc)
SOURCE_BY_MOD5 = ["claude", "chatgpt", "gemini", "obsidian", "manual"]
CATEGORY_BY_MOD7 = ["professional", "professional", "personal", "personal", "preference",
                    "project", "project"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(key, values) -> F.Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(key == i, F.lit(v)) if out is None else out.when(key == i, F.lit(v))
    return out


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memory records (schema ``memlake.schema.RECORD_SCHEMA``)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    epoch = int(VIEW_EPOCH.timestamp())
    created = F.timestamp_seconds(F.lit(epoch) + F.col("doc_id") * F.lit(3600))
    return (
        d.join(lab, "doc_id", "left")
        .select(
            F.col("doc_id").cast("string").alias("id"),
            F.col("text").alias("content"),
            _pick(F.col("doc_id") % 5, SOURCE_BY_MOD5).alias("source"),
            _pick(F.col("doc_id") % 7, CATEGORY_BY_MOD7).alias("category"),
            F.array(F.col("lang"), F.col("source")).alias("tags"),
            (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("sensitive"),
            F.when(F.col("doc_id") % 5 == 0, F.lit(0.92)).otherwise(F.lit(0.85)).alias("confidence"),
            created.alias("created_at"),
            created.alias("updated_at"),
            F.col("text").alias("source_raw"),
        )
    )


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as a batch of search queries / prompt tasks."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as manually added records (owner = conversation)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("owner"), F.col("turn").alias("pos"),
        F.col("text").alias("content"), F.col("role"),
    )


# DuckDB text of the same view, used by the oracle SQL.
RECORDS_SQL = """records AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS content,
    CASE d.doc_id % 5 WHEN 0 THEN 'claude' WHEN 1 THEN 'chatgpt' WHEN 2 THEN 'gemini'
                      WHEN 3 THEN 'obsidian' ELSE 'manual' END AS source,
    CASE d.doc_id % 7 WHEN 0 THEN 'professional' WHEN 1 THEN 'professional'
                      WHEN 2 THEN 'personal' WHEN 3 THEN 'personal'
                      WHEN 4 THEN 'preference' ELSE 'project' END AS category,
    [d.lang, d.source] AS tags,
    COALESCE(l.toxic, 0) = 1 AS sensitive,
    CASE WHEN d.doc_id % 5 = 0 THEN CAST(0.92 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS confidence,
    TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' HOUR AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' HOUR AS updated_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

"""Record schema, allowed values and record validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The allowed sources and categories, in their declared order.
SOURCES = ["claude", "chatgpt", "gemini", "obsidian", "manual"]
CATEGORIES = ["professional", "personal", "preference", "project", "relationship"]

RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("tags", T.ArrayType(T.StringType(), True), False),
    T.StructField("sensitive", T.BooleanType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("source_raw", T.StringType(), True),
])

RECORD_COLUMNS = [f.name for f in RECORD_SCHEMA.fields]
EXPORT_COLUMNS = [c for c in RECORD_COLUMNS if c != "source_raw"]

DEFAULT_CONFIDENCE = 0.8


def conform(df: DataFrame) -> DataFrame:
    """Project ``df`` onto the record schema (column order and types)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA.fields])


def _checks() -> list[tuple[str, Column]]:
    return [
        ("missing_id", F.col("id").isNull() | (F.col("id") == "")),
        ("missing_content", F.col("content").isNull()),
        ("bad_source", F.col("source").isNull() | ~F.col("source").isin(SOURCES)),
        ("bad_category", F.col("category").isNull() | ~F.col("category").isin(CATEGORIES)),
        ("bad_confidence", F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0)),
        ("missing_created_at", F.col("created_at").isNull()),
        ("missing_updated_at", F.col("updated_at").isNull()),
    ]


def with_problems(df: DataFrame) -> DataFrame:
    """Add ``problems ARRAY<STRING>``: the names of every failed check."""
    flags = [F.when(pred, F.lit(name)) for name, pred in _checks()]
    return df.withColumn("problems", F.array_compact(F.array(*flags)))


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows into ``(good, bad)``; ``bad`` keeps a ``problems`` array.

    One narrow projection, two filters; no shuffle.
    """
    checked = with_problems(df)
    good = checked.filter(F.size("problems") == 0).drop("problems")
    bad = checked.filter(F.size("problems") > 0)
    return good, bad

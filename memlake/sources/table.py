"""Record tables: typed read, legacy decode, schema upgrade, snapshots, export
(S11, S12, M7, M8).

Parquet has no in-place update, so every change is written as a new snapshot
directory ``<base>/v=<n>`` (partitioned by ``source`` for partition pruning);
a path that is being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.schema import EXPORT_COLUMNS, RECORD_COLUMNS, RECORD_SCHEMA


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a record table with the fixed schema: no footer is opened to
    infer one; columns that older files lack come as their defaults (M8)."""
    return upgrade_schema(spark.read.schema(RECORD_SCHEMA).parquet(path))


def upgrade_schema(df: DataFrame) -> DataFrame:
    """M8: add missing columns with their defaults (``sensitive`` false,
    ``tags`` empty, ``confidence`` 0.8, ``source_raw`` null); cast to the
    record types and order."""
    defaults = {
        "tags": F.array().cast("array<string>"),
        "sensitive": F.lit(False),
        "confidence": F.lit(0.8),
        "source_raw": F.lit(None).cast("string"),
    }
    cols = []
    for f in RECORD_SCHEMA.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if f.name in defaults:
                c = F.coalesce(c.cast(f.dataType), defaults[f.name])
            cols.append(c.cast(f.dataType).alias(f.name))
        elif f.name in defaults:
            cols.append(defaults[f.name].cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"required column {f.name!r} is missing")
    return df.select(*cols)


def decode_legacy(df: DataFrame) -> DataFrame:
    """Rows stored as text (tags as JSON text, sensitive as 0/1, times as
    ISO text) to typed record rows.  Undecodable tags become an empty list;
    undecodable times become null (and fail ``validate``)."""
    return df.select(
        F.col("id").cast("string"), F.col("content"), F.col("source"), F.col("category"),
        F.coalesce(F.from_json(F.col("tags"), "array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.col("sensitive").cast("int") != 0, F.lit(False)).alias("sensitive"),
        F.col("confidence").cast("double"),
        F.try_to_timestamp(F.col("created_at")).alias("created_at"),
        F.try_to_timestamp(F.col("updated_at")).alias("updated_at"),
        F.col("source_raw"),
    )


def snapshot_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/v={version}"


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """M7: write a new snapshot; fails rather than overwrite an existing one."""
    path = snapshot_path(base, version)
    df.select(*RECORD_COLUMNS).write.mode("errorifexists").partitionBy("source").parquet(path)
    return path


def append_records(df: DataFrame, path: str) -> None:
    """S9 sink: append new rows to a table partitioned by ``source``."""
    df.select(*RECORD_COLUMNS).write.mode("append").partitionBy("source").parquet(path)


def latest_version(spark: SparkSession, base: str) -> int | None:
    """Highest ``v=<n>`` under ``base`` whose write was committed (its marker
    is there; what a failed write left behind is passed over).  A directory
    listing, no data read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    best = None
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            try:
                n = int(name[2:])
            except ValueError:
                continue
            if (best is None or n > best) and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                best = n
    return best


def export_json(df: DataFrame, path: str, source: str | None = None) -> DataFrame:
    """Write the nine exported columns (no ``source_raw``) as JSON Lines,
    optionally one source only, newest first.  Returns a one-row frame with
    the number of rows written (counted while writing, via ``observe``)."""
    from pyspark.sql import Observation
    out = df if source is None else df.filter(F.col("source") == source)
    out = out.select(*EXPORT_COLUMNS).orderBy(F.col("created_at").desc(), F.col("id"))
    obs = Observation("export")
    out.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").json(path)
    n = obs.get["rows"]
    return df.sparkSession.createDataFrame([(int(n),)], "rows bigint")

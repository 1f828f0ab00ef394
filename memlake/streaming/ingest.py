"""Streaming import: the batch import (S1-S9) run on every micro-batch of
newly arrived export files.

``readStream`` on the export folder (whole-text files) feeds ``foreachBatch``:
parse the batch's files, plan against the key table of the stored contents
(first copy wins inside the batch, stored contents are skipped), append the
inserts and their keys and write the rejects.  What a batch reads does not grow
with the stored texts.  A re-run of a failed batch is idempotent: rows it
already appended have their keys, or get them first (``sources.keys``), so they
are skipped, and its rejects replace those of the first try (a folder per
batch).  Progress (which files
were seen) lives in the query's checkpoint location on shared storage.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.ingest import plan_import
from memlake.schema import RECORD_COLUMNS, RECORD_SCHEMA
from memlake.sources.exports import REJECT_COLUMNS, _elements, parse_elements
from memlake.sources.keys import KeyTable
from memlake.sources.platforms import get_platform
from memlake.sources.table import append_records
from memlake.util import drop_materialized, materialize


def _stored(spark: SparkSession, table_path: str) -> DataFrame:
    """The stored rows; none only if there is no such folder yet.  A table that
    cannot be read fails the batch: taking it for empty would import every row
    again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RECORD_SCHEMA)
    return spark.read.schema(RECORD_SCHEMA).parquet(table_path).select(*RECORD_COLUMNS)


def import_batch(batch: DataFrame, table_path: str, platform, as_of=None, batch_id: int = 0) -> None:
    """One micro-batch: ``(file, value)`` rows -> appended records and rejects."""
    spark = batch.sparkSession
    spec = get_platform(platform)
    as_of = as_of or _dt.datetime.now(_dt.timezone.utc)
    records, rejects = parse_elements(_elements(batch, spec), spec, as_of)
    keys = KeyTable(spark, f"{table_path.rstrip('/')}_keys")
    if not keys.in_step():
        keys.repair(_stored(spark, table_path))
    planned = plan_import(keys.read(), records)
    inserts = materialize(planned.filter(F.col("action") == "insert").select(*RECORD_COLUMNS), "inserts")
    keys.opened()
    append_records(inserts, table_path)
    keys.append(inserts)
    drop_materialized(inserts)
    rejects.select(*REJECT_COLUMNS).write.mode("overwrite").parquet(f"{table_path.rstrip('/')}_rejects/batch={batch_id}")


def start_import_stream(spark: SparkSession, watch_dir: str, table_path: str, platform,
                        checkpoint_location: str, as_of=None, available_now: bool = False,
                        max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    ``available_now=True`` processes what is there and stops (batch-style
    catch-up); otherwise it runs until stopped.
    """
    reader = spark.readStream.format("text").option("wholetext", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    src = reader.load(watch_dir).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(df: DataFrame, epoch_id: int) -> None:
        import_batch(df, table_path, platform, as_of, epoch_id)

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()

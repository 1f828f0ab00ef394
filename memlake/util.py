"""Plan helpers shared by operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession):
    """Let Spark delete the shuffle files of a finished write at once: what it
    made is a table now."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and reread it.

    Used only where one intermediate (a text index, a group table) feeds
    several branches or later queries.  The folder is the one the cluster names
    in ``spark.checkpoint.dir``, so the data survives the loss of any executor;
    ``drop_materialized`` removes the table when nothing reads it any more.
    """
    from memlake.session import checkpoint_dir
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/memlake-{name}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_at = path
    return out


def drop_materialized(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``materialize`` returned (other
    frames are left alone); whatever still has to read them must have been
    written itself."""
    for df in frames:
        path = getattr(df, "_materialized_at", None)
        if path is not None:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
            df._materialized_at = None

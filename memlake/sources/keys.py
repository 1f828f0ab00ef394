"""Key table: the content hashes of a growing table, beside it.

An import looks up whether a text is stored by its 64-character hash; with the
hashes in a table of their own, a micro-batch reads these and no stored text.
Every append of records is followed by one of their keys.  A marker is set
before the records are written and taken away after their keys are: if it is
still there, a job ended in between, and the keys that are missing are made
from the stored texts, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.operators.filters import content_key

KEY = "content_key"


class KeyTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str = "") -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def in_step(self) -> bool:
        """Whether every stored record has its key."""
        return self._exists() and not self._exists("_open")

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], f"{KEY} string")
        return self.spark.read.schema(f"{KEY} string").parquet(self.path)

    def opened(self) -> None:
        """From here to ``append`` records and keys may differ."""
        fs, path = self._at("_open")
        fs.mkdirs(path)

    def append(self, records: DataFrame) -> None:
        """The keys of ``records``, which are written already."""
        records.select(content_key().alias(KEY)).write.mode("append").parquet(self.path)
        fs, path = self._at("_open")
        fs.delete(path, True)

    def repair(self, stored: DataFrame) -> None:
        """Keys of the stored records that have none: one read of all texts."""
        self.opened()
        keyed = stored.select("content", content_key().alias(KEY))
        self.append(keyed.join(self.read(), KEY, "left_anti").select("content"))

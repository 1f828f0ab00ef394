"""Plan helpers shared by the operators of this subpackage.

Intermediates are written as Parquet tables in the folder that the cluster
names in ``spark.checkpoint.dir``, so they survive the loss of any executor,
and dropped as soon as what reads them is written itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.util import drop_materialized as dropped
from memlake.util import materialize as staged

__all__ = ["dropped", "id_text", "staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that any
    further columns of the caller, whatever their names, cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

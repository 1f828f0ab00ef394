"""Pipeline over ``documents``: toxicity, near-duplicates, decontamination, PII, packing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``docs``, the last returns packed pieces.  ``run`` writes what a stage returns as
a Parquet table in the shared folder and reads it again for the next one, so a
lost executor never goes back further than one stage.

Rows with a null id or text pass through the filters (they cannot be told from
clean ones) and are packed as a lone end id; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import catalog, pii, toxicity
from memlake.llm.common import dropped, staged, table
from memlake.llm.decontamination import contamination
from memlake.llm.minhash_dedup import near_duplicates
from memlake.llm.packing import pack


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go."""
    return toxicity.without_toxic(docs, catalog.toxicity_machine(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class stays."""
    gone = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go."""
    gone = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in the texts; n_chars follows."""
    replaced = pii.replace(docs, pii.checked_surrogates(docs, catalog.SURROGATE_KEY))
    n_chars = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return replaced.withColumn("n_chars", n_chars).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_private),
    ("packing", pack_windows),
]

#: No stage before packing but decontamination can be stated in SQL; tests hold the stages to their operators, which are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(docs)           # the stage before, once this one is written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

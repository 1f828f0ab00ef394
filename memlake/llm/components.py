"""Connected components of a link table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def components(links: DataFrame, tag: str, most_rounds: int = 64) -> DataFrame:
    """(node, comp) of all nodes of ``links`` (a, b); comp is the component's
    smallest node.  A round gives each node the least label around it, then the
    label of its label; every round is written as a table."""
    both = staged(links.select(F.col("a").alias("node"), F.col("b").alias("near"))
                  .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near"))), f"{tag}-links")
    labels = staged(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("comp")), f"{tag}-labels")
    for _ in range(most_rounds):
        around = (both.join(labels.select(F.col("node").alias("near"), "comp"), "near")
                  .select("node", "comp").unionByName(labels).groupBy("node").agg(F.min("comp").alias("comp")))
        around = staged(around, f"{tag}-around")
        jumped = (around.join(around.select(F.col("node").alias("comp"), F.col("comp").alias("further")), "comp", "left")
                  .select("node", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        after = staged(jumped, f"{tag}-labels")
        changed = after.join(labels.withColumnRenamed("comp", "before"), "node").where("comp <> before").limit(1).count()
        dropped(around, labels)
        labels = after
        if not changed:
            dropped(both)
            return labels
    raise RuntimeError("components did not settle")

"""Import planning and import.

One job: incoming rows are keyed by a hash of their text; the first
occurrence of each text in input order is found with a partial aggregate (a
text repeated in a third of the batch collapses map-side, D2), and those
first rows, one for each text, are anti-joined with the stored texts (D1).
What is left is marked in the batch by its place in it, a unique key, so the
copies of a hot text never meet in one task.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.timefn import ts_lit
from memlake.operators.dedup import dedup_batch, new_rows
from memlake.schema import RECORD_COLUMNS

MANUAL_CONFIDENCE = 0.9


def plan_import(table: DataFrame, incoming: DataFrame, order_cols=("file", "pos"),
                by: list[str] | None = None) -> DataFrame:
    """Every incoming row with ``action``: ``insert`` (first copy of a text
    not yet stored) or ``duplicate`` (stored already, or repeated in the batch).
    ``order_cols`` tell incoming rows apart (file and position do)."""
    by, order = list(by or []), list(order_cols)
    first = new_rows(table, dedup_batch(incoming.select(*by, *order, "content"), order, by), by)
    marks = first.select(*by, *order).withColumn("_insert", F.lit(True))
    marked = incoming.join(marks, by + order, "left")
    return marked.withColumn("action", F.when(F.col("_insert"), "insert").otherwise("duplicate")).drop("_insert")


def import_records(table: DataFrame, incoming: DataFrame, skip_duplicates: bool = True,
                   order_cols=("file", "pos"), by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(new_table, report)``.

    ``report`` is ``(metric, key, value)``: added, duplicates, total, and the
    per-source counts of the new table, from one aggregate over the stored and
    the planned rows.  With ``skip_duplicates=False`` every row is added (ids
    must still be unique: see ``dedup.check_keys``).
    """
    planned = plan_import(table, incoming, order_cols, by) if skip_duplicates else incoming.withColumn("action", F.lit("insert"))
    new_table = table.select(*RECORD_COLUMNS).unionByName(planned.filter(F.col("action") == "insert").select(*RECORD_COLUMNS))
    counts = (table.select("source", F.lit("stored").alias("action")).unionByName(planned.select("source", "action"))
              .groupBy("source", "action").agg(F.count(F.lit(1)).alias("n")))
    none, stays = F.lit(None).cast("string"), F.col("action") != "duplicate"
    metric = lambda name, key: F.struct(F.lit(name).alias("metric"), key.alias("key"), F.col("n").alias("value"))
    rows = F.array_compact(F.array(
        F.when(F.col("action") == "insert", metric("added", none)), F.when(~stays, metric("duplicates", none)),
        F.when(stays, metric("total", none)), F.when(stays, metric("by_source", F.col("source")))))
    report = counts.select(F.inline(rows)).groupBy("metric", "key").agg(F.sum("value").alias("value"))
    return new_table, report


def manual_records(df: DataFrame, as_of) -> DataFrame:
    """Manually added rows -> records.  Input needs ``content`` and
    ``category``; ``source`` defaults to manual, ``tags`` to empty,
    ``sensitive`` to false; confidence 0.9; both times ``as_of``.  The id is
    a hash of source, text and time (stable under task retries)."""
    cols = set(df.columns)
    src = F.coalesce(F.col("source"), F.lit("manual")) if "source" in cols else F.lit("manual")
    tags = (F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in cols
            else F.array().cast("array<string>"))
    sens = F.coalesce(F.col("sensitive"), F.lit(False)) if "sensitive" in cols else F.lit(False)
    t = ts_lit(as_of)
    extra = [c for c in ("file", "pos", "owner") if c in cols]
    out = df.select(src.alias("source"), F.col("content"), F.col("category"), tags.alias("tags"),
                    sens.alias("sensitive"), *extra)
    rid = F.sha2(F.concat_ws("|", F.col("source"), F.col("content"),
                             *[F.col(c).cast("string") for c in extra]), 256)
    return out.select(rid.alias("id"), "content", "source", "category", "tags", "sensitive",
                      F.lit(MANUAL_CONFIDENCE).alias("confidence"), t.alias("created_at"),
                      t.alias("updated_at"), F.lit(None).cast("string").alias("source_raw"), *extra)

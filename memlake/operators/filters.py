"""Filters, lookups and paging.

Equality filters on ``source`` / ``category`` / ``sensitive`` reach the parquet
scan as pushed filters (and partition pruning when the table is partitioned by
``source``).  Orderings are total: newest first, then ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.timefn import stale_cutoff
from memlake.operators.rules import Rules, exclude


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").asc()]


def oldest_first() -> list[Column]:
    return [F.col("created_at").asc(), F.col("id").asc()]


def by_category(df: DataFrame, category: str) -> DataFrame:
    """one category, newest first."""
    return df.filter(F.col("category") == category).orderBy(*newest_first())


def by_source(df: DataFrame, source: str) -> DataFrame:
    """one source, newest first."""
    return df.filter(F.col("source") == source).orderBy(*newest_first())


def sensitive(df: DataFrame) -> DataFrame:
    """sensitive rows, newest first."""
    return df.filter(F.col("sensitive")).orderBy(*newest_first())


def stale(df: DataFrame, as_of, threshold_days: int = 180) -> DataFrame:
    """created before ``as_of - N days``, oldest first."""
    return df.filter(F.col("created_at") < stale_cutoff(as_of, threshold_days)).orderBy(*oldest_first())


def lookup(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """rows whose id is in the key set (semi-join; the key side is
    de-duplicated first so a repeated key cannot skew the join)."""
    keys = ids.select(F.col(id_col).alias("id")).distinct()
    return df.join(keys, "id", "left_semi")


def id_exists(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, exists)`` for every distinct requested id."""
    keys = ids.select(F.col(id_col).alias("id")).distinct()
    present = df.select("id").distinct().withColumn("_hit", F.lit(True))
    return keys.join(present, "id", "left").select(
        "id", F.coalesce(F.col("_hit"), F.lit(False)).alias("exists"))


def content_key(col="content") -> Column:
    """SHA-256 of the text: a fixed-width join key for exact-content matching,
    so shuffles move 32 bytes instead of whole texts."""
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)


def content_exists(df: DataFrame, contents: DataFrame, content_col: str = "content") -> DataFrame:
    """``(content_key, exists)`` for each distinct requested text (exact,
    case-sensitive); the original text is kept as ``content``."""
    req = (contents.select(F.col(content_col).alias("content"))
           .withColumn("content_key", content_key()))
    req = req.groupBy("content_key").agg(F.any_value("content").alias("content"))
    present = df.select(content_key().alias("content_key")).distinct().withColumn("_hit", F.lit(True))
    return req.join(present, "content_key", "left").select(
        "content_key", "content", F.coalesce(F.col("_hit"), F.lit(False)).alias("exists"))


def page(df: DataFrame, limit: int = 100, offset: int = 0, by=()) -> DataFrame:
    """L1: newest-first page; a top-(offset+limit) per partition, then merge.
    With ``by``, a page of each owner (a ranked window, cut in every task
    before the shuffle)."""
    if by:
        from pyspark.sql import Window
        w = Window.partitionBy(*by).orderBy(*newest_first())
        ranked = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= offset + limit)
        return ranked.filter(F.col("_n") > offset).drop("_n")
    ordered = df.orderBy(*newest_first())
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def page_after(df: DataFrame, created_at, id, limit: int = 100) -> DataFrame:
    """L1 deep in a table: the newest-first page behind the row (``created_at``,
    ``id``), the last one of the page before.  The bound reaches the scan as a
    filter and ``limit`` rows a partition are merged, however deep the page is;
    ``page(offset=...)`` sends all rows before it through one task."""
    behind = F.lit(created_at).cast("timestamp")
    rest = df.where((F.col("created_at") <= behind) & ((F.col("created_at") < behind) | (F.col("id") > F.lit(id))))
    return rest.orderBy(*newest_first()).limit(limit)


def visible_page(df: DataFrame, rules: Rules | DataFrame | None = None, limit: int = 20,
                 offset: int = 0, by=()) -> tuple[DataFrame, DataFrame]:
    """L2: rules first, then the page; also the visible total (one row, or one
    per owner)."""
    visible = exclude(df, rules, list(by) if isinstance(rules, DataFrame) else None)
    total = visible.groupBy(*by).agg(F.count(F.lit(1)).alias("total_visible"))
    return page(visible, limit, offset, by), total


def visible_category(df: DataFrame, category: str, rules: Rules | None = None) -> DataFrame:
    """L3: one category with rules applied, newest first."""
    return exclude(by_category(df, category), rules)


def with_position(page_df: DataFrame, start: int = 1) -> DataFrame:
    """Number the rows of an already bounded (paged / top-k) result."""
    from pyspark.sql import Window
    w = Window.orderBy(*newest_first())
    return page_df.withColumn("position", F.row_number().over(w) + F.lit(start - 1))

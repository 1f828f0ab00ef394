"""Bulk changes (M1-M6): each applies a *table* of changes and returns
``(new_table, report)``; ``report`` is ``(metric, value)`` with ``matched``
and ``not_found`` counts (the bulk form of a per-id true/false).

Changes are joined to the table on ``id`` (a left join keeps every stored
row; the change side is de-duplicated first, last ``seq`` wins when given).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.timefn import ts_lit
from memlake.schema import CATEGORIES, RECORD_COLUMNS


def _one_per_id(changes: DataFrame) -> DataFrame:
    """One change per id: the highest ``seq`` wins (a partial aggregate, so a
    heavily repeated id is reduced map-side).  Without a ``seq`` column ids may
    not repeat; a repeated one fails the job rather than pick a change by chance."""
    rest = [c for c in changes.columns if c not in ("id", "seq")]
    if "seq" in changes.columns:
        best = changes.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("_c"))
    else:
        best = changes.groupBy("id").agg(F.any_value(F.struct(*rest)).alias("_one"), F.count(F.lit(1)).alias("_n"))
        best = best.select("id", F.when(F.col("_n") == 1, F.col("_one")).otherwise(F.raise_error(
            F.concat(F.lit("several changes of one id need a seq column: "), F.col("id")))).alias("_c"))
    return best.select("id", *[F.col("_c")[c].alias(c) for c in rest])


def _report(table: DataFrame, changes: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """One left join and one aggregate; ``rejected`` counts refused changes."""
    ids = changes.select("id").distinct().join(table.select("id", F.lit(True).alias("_hit")), "id", "left")
    counts = ids.agg(F.count_if(F.col("_hit")).alias("m"), F.count_if(F.col("_hit").isNull()).alias("n"))
    row = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    out = counts.select(F.inline(F.array(row("matched", F.col("m")), row("not_found", F.col("n")))))
    if rejected is None:
        return out
    return out.unionByName(rejected.agg(F.count(F.lit(1)).alias("value")).select(F.lit("rejected").alias("metric"), "value"))


def _apply(table: DataFrame, changes: DataFrame, setters: dict, as_of) -> DataFrame:
    ch = _one_per_id(changes).select("id", *[F.col(c).alias(f"_n_{c}") for c in changes.columns
                                             if c not in ("id", "seq")], F.lit(True).alias("_hit"))
    j = table.join(ch, "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    cols = []
    for c in RECORD_COLUMNS:
        if c in setters:
            cols.append(F.when(hit, setters[c]).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, ts_lit(as_of)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def with_change_problems(changes: DataFrame, content_required: bool) -> DataFrame:
    """P9 for changes: a category outside the allowed set, or a null content
    where one is set, is named in ``problems``."""
    flags = [F.when(F.col("id").isNull(), F.lit("missing_id"))]
    if "category" in changes.columns:
        flags.append(F.when(F.col("category").isNotNull() & (F.col("category") != "") & ~F.col("category").isin(CATEGORIES),
                            F.lit("bad_category")))
    if content_required:
        flags.append(F.when(F.col("content").isNull(), F.lit("missing_content")))
    return changes.withColumn("problems", F.array_compact(F.array(*flags)))


def split_changes(changes: DataFrame, content_required: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``; rejected changes keep their ``problems``."""
    checked = with_change_problems(changes, content_required)
    return checked.filter(F.size("problems") == 0).drop("problems"), checked.filter(F.size("problems") > 0)


def apply_updates(table: DataFrame, changes: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1: ``(id, content[, category][, tags])``: content is set as given; an
    empty or null category keeps the old one; null tags keep the old tags, an
    empty list clears them; ``updated_at`` = as_of.  Invalid changes (P9) are
    not applied: ``(new_table, rejected, report)``."""
    changes, rejected = split_changes(changes)
    setters = {"content": F.col("_n_content")}
    if "category" in changes.columns:
        setters["category"] = F.coalesce(F.nullif(F.col("_n_category"), F.lit("")), F.col("category"))
    if "tags" in changes.columns:
        setters["tags"] = F.coalesce(F.col("_n_tags"), F.col("tags"))
    return _apply(table, changes, setters, as_of), rejected, _report(table, changes, rejected)


def apply_edits(table: DataFrame, changes: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M2: like M1 but an empty or null content keeps the old one, and tags
    come as comma-separated text (items trimmed, blanks kept; null = keep)."""
    changes, rejected = split_changes(changes, content_required=False)
    setters = {"content": F.coalesce(F.nullif(F.col("_n_content"), F.lit("")), F.col("content"))}
    if "category" in changes.columns:
        setters["category"] = F.coalesce(F.nullif(F.col("_n_category"), F.lit("")), F.col("category"))
    if "tags" in changes.columns:
        parsed = F.transform(F.split(F.col("_n_tags"), ","), lambda x: F.trim(x))
        setters["tags"] = F.when((F.col("_n_tags").isNull()) | (F.col("_n_tags") == ""), F.col("tags")) \
            .otherwise(parsed)
    return _apply(table, changes, setters, as_of), rejected, _report(table, changes, rejected)


def apply_sensitive(table: DataFrame, changes: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """M3: ``(id, sensitive)``: set or clear the flag; ``updated_at`` = as_of."""
    return _apply(table, changes, {"sensitive": F.col("_n_sensitive").cast("boolean")}, as_of), \
        _report(table, changes)


def delete_ids(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M4: remove rows by id (anti-join against the distinct ids)."""
    keys = ids.select("id").distinct()
    return table.join(keys, "id", "left_anti"), _report(table, keys)


def clear_source(table: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """M5: drop one source (a partition drop when partitioned by source)."""
    gone = table.filter(F.col("source") == source).agg(F.count(F.lit(1)).alias("value"))
    return table.filter(F.col("source") != source), gone.select(F.lit("deleted").alias("metric"), "value")


def clear_all(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6: an empty table with the same schema, and the number of rows removed."""
    gone = table.agg(F.count(F.lit(1)).alias("value"))
    return table.limit(0), gone.select(F.lit("deleted").alias("metric"), "value")


LOG_OPS = ("update", "edit", "sensitive", "delete", "clear_source", "clear_all")


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)`` entries of a change log; see ``apply_log``."""
    by_id = F.col("op").isin(*LOG_OPS[:4])
    problems = F.array_compact(F.array(
        F.when(F.coalesce(~F.col("op").isin(*LOG_OPS), F.lit(True)), F.lit("bad_op")),
        F.when(by_id & F.col("id").isNull(), F.lit("missing_id")),
        F.when(F.col("op").isin("update", "edit") & (F.col("category") != "") & ~F.col("category").isin(CATEGORIES), F.lit("bad_category")),
        F.when((F.col("op") == "update") & F.col("content").isNull(), F.lit("missing_content")),
        F.when((F.col("op") == "clear_source") & F.col("source").isNull(), F.lit("missing_source"))))
    checked = log.withColumn("problems", problems)
    return checked.where(F.size("problems") == 0).drop("problems"), checked.where(F.size("problems") > 0)


def apply_log(table: DataFrame, log: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """M1-M5 of mixed kinds as one ordered log, equal to applying its entries
    one by one in the order of ``seq``: ``(new_table, rejected)``.

    ``log``: ``(seq, op, id, content, category, tags, sensitive, source)`` with
    ``op`` one of ``LOG_OPS``; the tags of an ``edit`` are comma-separated text in
    ``tag_text`` (a column that may be missing).  No entry adds a row, so a row
    deleted at any place stays deleted, and of each field the last entry that
    sets it counts.  Both are partial aggregates a field: the entries of a hot id
    are folded where they lie and never gathered.
    """
    good, rejected = split_log(log)
    op, edit = F.col("op"), F.col("op") == "edit"

    def last(value, when):
        return F.max(F.when(when, F.struct("seq", value.alias("v"))))["v"]

    set_tags = (op == "update") & F.col("tags").isNotNull()
    tags = F.col("tags")
    if "tag_text" in log.columns:
        typed = edit & (F.col("tag_text") != "")
        tags = F.when(typed, F.transform(F.split("tag_text", ","), lambda x: F.trim(x))).otherwise(tags)
        set_tags = set_tags | F.coalesce(typed, F.lit(False))
    folded = good.where(op.isin(*LOG_OPS[:4])).groupBy("id").agg(
        last(F.col("content"), (op == "update") | (edit & (F.col("content") != ""))).alias("_content"),
        last(F.col("category"), op.isin("update", "edit") & (F.col("category") != "")).alias("_category"),
        last(tags, set_tags).alias("_tags"),
        last(F.col("sensitive"), op == "sensitive").alias("_sensitive"),
        F.max(op == "delete").alias("_gone"), F.lit(True).alias("_hit"))
    cleared = good.where(op == "clear_source").select("source").distinct()
    left = table.join(cleared, "source", "left_anti").where(~good.where(op == "clear_all").exists())
    j = left.join(folded, "id", "left").where(F.coalesce(~F.col("_gone"), F.lit(True)))
    changed = {c: F.coalesce(f"_{c}", c) for c in ("content", "category", "tags", "sensitive")}
    changed["updated_at"] = F.when(F.col("_hit"), ts_lit(as_of)).otherwise(F.col("updated_at"))
    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in RECORD_COLUMNS]), rejected

"""Context packs and context-augmented prompts (K1-K5).

A pack names an ordered list of categories plus tag exclusions.  Members of
*all* packs are computed in one job: the pack table's categories are exploded
with their position and equi-joined to the records on ``category`` (the pack
side is tiny and broadcast by AQE at runtime), then the exclusion rules and
the pack's own and call-time tag exclusions are applied.  Pack ``tags`` are
stored but, as in the reference, never used to select members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions.text import context_line
from memlake.operators.keyword import keyword_search
from memlake.operators.rules import Rules, exclude, exclude_tags

PACK_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("categories", T.ArrayType(T.StringType()), False),
    T.StructField("tags", T.ArrayType(T.StringType()), False),
    T.StructField("exclude_tags", T.ArrayType(T.StringType()), False),
    T.StructField("description", T.StringType(), False),
])


def _csv(col, keep_blanks: bool) -> F.Column:
    items = F.transform(F.split(F.col(col), ","), lambda x: F.trim(x))
    if not keep_blanks:
        items = F.filter(items, lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.when(F.col(col).isNull() | (F.col(col) == ""), empty).otherwise(items)


def parse_pack_defs(defs: DataFrame) -> DataFrame:
    """``(name, categories, tags, exclude_tags, description[, seq])`` with CSV
    text fields to the pack schema (items trimmed, blanks kept as given)."""
    out = defs.select(
        "name", _csv("categories", True).alias("categories"), _csv("tags", True).alias("tags"),
        _csv("exclude_tags", True).alias("exclude_tags"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        *(["seq"] if "seq" in defs.columns else []))
    return out


def define_packs(existing: DataFrame, defs: DataFrame) -> DataFrame:
    """K1: a definition replaces any pack of the same name; among several
    definitions of one name in ``defs`` the highest ``seq`` wins."""
    new = parse_pack_defs(defs) if "categories" in defs.columns and \
        dict(defs.dtypes)["categories"] == "string" else defs
    if "seq" in new.columns:
        rest = [c for c in new.columns if c not in ("name", "seq")]
        best = new.groupBy("name").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("_p"))
        new = best.select("name", *[F.col("_p")[c].alias(c) for c in rest])
    new = new.select(*[f.name for f in PACK_SCHEMA.fields])
    kept = existing.join(new.select("name"), "name", "left_anti")
    return kept.unionByName(new)


def drop_packs(packs: DataFrame, names: DataFrame) -> DataFrame:
    """K4."""
    return packs.join(names.select("name").distinct(), "name", "left_anti")


def pack_members(df: DataFrame, packs: DataFrame, rules: Rules | DataFrame | None = None,
                 extra_exclude_tags=(), by=()) -> DataFrame:
    """K2: ``(pack, cat_pos, …record)`` for every pack, categories in listed
    order (a repeated category repeats its rows), newest first inside each.
    With ``by``, packs carry the owner columns and hold their owner's rows."""
    by = list(by)
    cats = packs.select(*by, F.col("name").alias("pack"), F.col("exclude_tags").alias("_pack_ex"),
                        F.posexplode("categories").alias("cat_pos", "category"))
    # category has a handful of values: AQE broadcasts a small pack table, and
    # splits the partitions of a category where it is too large for that.
    members = df.join(cats, [*by, "category"])
    members = exclude(members, rules if rules is not None else Rules(), *([by] if isinstance(rules, DataFrame) else []))
    hit = F.coalesce(F.arrays_overlap("tags", "_pack_ex"), F.lit(False)) & (F.size("_pack_ex") > 0)
    return exclude_tags(members.filter(~hit), extra_exclude_tags).drop("_pack_ex")


def pack_lines(members: DataFrame, packs: DataFrame) -> DataFrame:
    """K3 as ordered lines ``(pack, part, cat_pos, created_at, id, line)``.

    Sorting by ``(pack, part, cat_pos, created_at desc, id)`` and writing the
    ``line`` column as text gives each pack's block: ``# name``, ``# description``
    when present, a blank line, then one context line per member.  Packs with
    no members produce no lines.  Kept in long form so a large pack is never
    gathered into one row.
    """
    body = members.select(F.col("pack"), F.lit(2).alias("part"), "cat_pos", "created_at", "id",
                          context_line().alias("line"))
    present = members.select("pack").distinct()
    hdr = packs.join(present.withColumnRenamed("pack", "name"), "name", "left_semi")
    ts0 = F.lit(None).cast("timestamp")
    heads = hdr.select(F.col("name").alias("pack"), F.lit(0).alias("part"), F.lit(0).alias("cat_pos"),
                       ts0.alias("created_at"), F.lit("0").alias("id"),
                       F.concat(F.lit("# "), F.col("name")).alias("line"))
    desc = hdr.filter(F.col("description") != "").select(
        F.col("name").alias("pack"), F.lit(1).alias("part"), F.lit(0).alias("cat_pos"),
        ts0.alias("created_at"), F.lit("1").alias("id"),
        F.concat(F.lit("# "), F.col("description")).alias("line"))
    blank = hdr.select(F.col("name").alias("pack"), F.lit(1).alias("part"), F.lit(1).alias("cat_pos"),
                       ts0.alias("created_at"), F.lit("2").alias("id"), F.lit("").alias("line"))
    return heads.unionByName(desc).unionByName(blank).unionByName(body)


def pack_line_order():
    return [F.col("pack"), F.col("part"), F.col("cat_pos"), F.col("created_at").desc(), F.col("id")]


def prompts(df: DataFrame, tasks: DataFrame, rules: Rules | DataFrame | None = None, limit: int = 8,
            task_col: str = "query", key_cols=("query_id",), by=()) -> DataFrame:
    """K5: ``(…keys, …by, prompt)`` for every task.

    Keyword search (limit ``limit``), then the rules (no refill), then the
    context block: ``## Personal Context``, the context lines in rank order, a
    ``---`` separator and the task; a task with no visible hit is returned bare.
    At most ``limit`` lines are gathered per task.  With ``by``, a task carries
    the owner columns and sees its owner's rows and rules.
    """
    by = list(by)
    keys = [*key_cols, *[c for c in by if c not in key_cols]]
    hits = keyword_search(df, tasks, limit=limit, query_col=task_col, key_cols=key_cols, by=by)
    rec = df.select(*by, "id", "content", "category", "tags", "sensitive")
    visible = exclude(hits.join(rec, [*by, "id"]), rules if rules is not None else Rules(), *([by] if isinstance(rules, DataFrame) else []))
    lines = visible.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rank", context_line().alias("line")))).alias("_l"))
    block = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    # Whole texts: merged, as files and shuffles say little about their size in memory.
    out = tasks.select(*keys, F.col(task_col).alias("_task")).join(lines.hint("merge"), keys, "left")
    prompt = F.when(F.col("_l").isNull(), F.col("_task")).otherwise(
        F.concat(F.lit("## Personal Context\n"), block, F.lit("\n\n---\n\n"), F.col("_task")))
    return out.select(*keys, prompt.alias("prompt"))

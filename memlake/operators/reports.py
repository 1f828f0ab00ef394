"""Counts, stats, coverage and health.

Every report is an aggregate keyed by the scope columns ``by`` (default: one
scope, the reference's semantics).  Partial aggregation runs map-side, so a
hot scope costs one partial row per task, not one task holding its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.timefn import stale_cutoff, age_days
from memlake.operators.rules import Rules, active_rules, rules_frame
from memlake.schema import CATEGORIES


def count_all(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"))


def count_by_source(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A2."""
    return df.groupBy(*(by or []), "source").agg(F.count(F.lit(1)).alias("n"))


def count_by_category(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A3."""
    return df.groupBy(*(by or []), "category").agg(F.count(F.lit(1)).alias("n"))


def stats(df: DataFrame, as_of, rules: Rules | None = None, by: list[str] | None = None,
          threshold_days: int = 180) -> DataFrame:
    """A4 in long format ``(…by, metric, key, value)``.

    One scan with grouping sets ``(), (source), (category)`` computes the
    total, sensitive and stale counts and both breakdowns; the active rules
    are appended as ``rule`` rows (value = 1, key = ``name=json``).
    """
    by = list(by or [])
    cutoff = stale_cutoff(as_of, threshold_days)
    g = df.groupingSets([by, by + ["source"], by + ["category"]], *by, "source", "category").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("sensitive")).alias("sensitive"),
        F.count_if(F.col("created_at") < cutoff).alias("stale"),
        F.grouping("source").alias("_gs"), F.grouping("category").alias("_gc"))
    # One aggregate, then its result rows by grouping set: the scan runs once.
    row = lambda name, key, value: F.struct(F.lit(name).alias("metric"), key.alias("key"), F.col(value).alias("value"))
    none = F.lit(None).cast("string")
    rows = (F.when(F.col("_gs") == 0, F.array(row("by_source", F.col("source"), "total")))
            .when(F.col("_gc") == 0, F.array(row("by_category", F.col("category"), "total")))
            .otherwise(F.array(*[row(m, none, m) for m in ("total", "sensitive", "stale")])))
    out = g.select(*by, F.inline(rows))
    if rules is not None and not by:
        rf = active_rules(rules_frame(df.sparkSession, rules), only_active=True)
        out = out.unionByName(rf.select(
            F.lit("rule").alias("metric"), F.concat_ws("=", "rule", "value").alias("key"),
            F.lit(1).cast("bigint").alias("value")))
    return out


def _known_categories(spark) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category string, cat_order int")


def missing_categories(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A5: known categories with no rows (per scope).

    The known list is a fixed 5-row table, so crossing it with the scopes is
    bounded by 5 x owners; it is joined on the category key, never crossed
    with records.
    """
    by = list(by or [])
    present = df.select(*by, "category").distinct()
    known = _known_categories(df.sparkSession)
    if not by:
        return known.join(present, "category", "left_anti").select("category", "cat_order")
    scopes = df.select(*by).distinct()
    # Explode the 5 known names onto each scope (a literal array, no join).
    grid = scopes.select(*by, F.posexplode(F.array(*[F.lit(c) for c in CATEGORIES]))
                         .alias("cat_order", "category"))
    return grid.join(present, by + ["category"], "left_anti").select(*by, "category", "cat_order")


def health_inputs(df: DataFrame, as_of, pair_counts: DataFrame, by: list[str] | None = None,
                  threshold_days: int = 180) -> DataFrame:
    """Per scope: total, stale (F4), sensitive, near-duplicate pairs, missing categories.

    ``pair_counts`` is ``(…by, pairs)``.  Both inputs are reduced to per-scope
    partial rows and combined by one union + aggregate (no join).
    """
    by = list(by or [])
    cutoff = stale_cutoff(as_of, threshold_days)
    zero = F.lit(0).cast("bigint")
    rows = df.select(
        *by, F.lit(1).cast("bigint").alias("total"),
        (F.col("created_at") < cutoff).cast("bigint").alias("stale"),
        F.col("sensitive").cast("bigint").alias("sensitive"),
        zero.alias("pairs"),
        *[(F.col("category") == c).cast("bigint").alias(f"_c_{c}") for c in CATEGORIES])
    pairs = pair_counts.select(
        *by, zero.alias("total"), zero.alias("stale"), zero.alias("sensitive"),
        F.col("pairs").cast("bigint").alias("pairs"), *[zero.alias(f"_c_{c}") for c in CATEGORIES])
    agg = rows.unionByName(pairs).groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ["total", "stale", "sensitive", "pairs"]],
        *[F.sum(f"_c_{c}").alias(f"_c_{c}") for c in CATEGORIES])
    missing = sum((F.col(f"_c_{c}") == 0).cast("int") for c in CATEGORIES)
    return agg.withColumn("missing", missing.cast("bigint")).drop(*[f"_c_{c}" for c in CATEGORIES])


def health(inputs: DataFrame) -> DataFrame:
    """A6 + A7: score, grade and review tip from ``health_inputs``.

    score = 100 - min(30, int(stale/total*100)) - min(20, 5*pairs) - 5*missing,
    floored at 0; scopes with no rows produce no row.
    """
    stale_pen = F.least(F.lit(30), F.floor(F.col("stale") / F.col("total") * 100).cast("bigint"))
    dup_pen = F.least(F.lit(20), F.col("pairs") * 5)
    score = F.greatest(F.lit(0), F.lit(100) - stale_pen - dup_pen - F.col("missing") * 5).cast("bigint")
    out = inputs.filter(F.col("total") > 0).withColumn("score", score)
    grade = (F.when(F.col("score") >= 85, "A").when(F.col("score") >= 70, "B")
             .when(F.col("score") >= 50, "C").otherwise("D"))
    return out.withColumn("grade", grade).withColumn("review_tip", F.col("score") < 70)


def stalest(df: DataFrame, as_of, n: int = 5, by: list[str] | None = None,
            threshold_days: int = 180) -> DataFrame:
    """A8 (first half): the ``n`` oldest stale rows per scope, with age in days."""
    by = list(by or [])
    st = df.filter(F.col("created_at") < stale_cutoff(as_of, threshold_days))
    w = Window.partitionBy(*by).orderBy(F.col("created_at").asc(), F.col("id").asc())
    return (st.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .withColumn("age_days", age_days(as_of)))

"""Keyword classification and tagging (P1-P3), generated from a PlatformSpec.

All matching is substring matching on the lower-cased text, done with JVM
``contains``; a row is touched once, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.sources.platforms import PlatformSpec, get_platform


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _score(lc: Column, keywords) -> Column:
    # Count of keywords (as written, not lower-cased) found in the lowered text.
    terms = [F.when(lc.contains(F.lit(k)), F.lit(1)).otherwise(F.lit(0)) for k in keywords]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def category_scores(col, spec: PlatformSpec | str) -> Column:
    """STRUCT of per-category keyword hit counts, in rule order."""
    spec = get_platform(spec)
    lc = F.lower(_c(col))
    return F.struct(*[_score(lc, kws).alias(cat) for cat, kws in spec.category_rules])


def classify_scores(scores, spec: PlatformSpec | str) -> Column:
    """Category from an already computed ``category_scores`` struct."""
    spec = get_platform(spec)
    scores = F.col(scores) if isinstance(scores, str) else scores
    cats = [cat for cat, _ in spec.category_rules]
    best = F.greatest(*[scores[c] for c in cats])
    out = F.when(best <= 0, F.lit(spec.default_category))
    for c in cats:
        out = out.when(scores[c] == best, F.lit(c))
    return out.otherwise(F.lit(spec.default_category))


def classify(col, spec: PlatformSpec | str) -> Column:
    """Highest-scoring category; ties go to the earlier rule; no hit -> default.

    For wide tables prefer ``classify_frame``, which projects the scores once.
    """
    return classify_scores(category_scores(col, spec), spec)


def classify_frame(df, spec: PlatformSpec | str, col: str = "content", out: str = "category",
                   keep_scores: bool = False):
    """Add ``out`` (and optionally ``scores``) to ``df``: the scores struct is
    materialised by one projection so every keyword test runs once per row."""
    spec = get_platform(spec)
    scored = df.withColumn("_scores", category_scores(col, spec))
    res = scored.withColumn(out, classify_scores("_scores", spec))
    return res.withColumnRenamed("_scores", "scores") if keep_scores else res.drop("_scores")


def extract_tags(col, spec: PlatformSpec | str) -> Column:
    """Tags whose keyword (lower-cased) occurs in the lowered text: map order,
    distinct, at most ``spec.max_tags`` (P3)."""
    spec = get_platform(spec)
    lc = F.lower(_c(col))
    hits = [F.when(lc.contains(F.lit(k.lower())), F.lit(tag)) for k, tag in spec.tag_map]
    return F.slice(F.array_distinct(F.array_compact(F.array(*hits))), 1, spec.max_tags)

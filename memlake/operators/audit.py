"""Personal-data audit.

One pass over the table: each row gets the array of pattern labels that match
it at least once, which is exploded to one issue row per (row, label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The audit patterns, in report order.  They are applied with
# Unicode character classes ((?U)) so \d, \b and \s behave as in Python 3.
AUDIT_PATTERNS = [
    ("email", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    ("phone", r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("api_key", r"(?i)\b(sk-|pk-|api[-_]?key)[A-Za-z0-9_\-]{10,}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d[ -]?){13,16}\b"),
]


def _java(p: str) -> str:
    return "(?U)" + p


# Each pattern has a mandatory part that a much cheaper test can look for
# first; the full pattern only runs on rows that pass it (exact: a row that
# fails the guard cannot match).  Same (?U) classes and case folding.
def _guards() -> dict:
    digit = F.col("content").rlike(r"(?U)\d")
    return {
        "email": F.col("content").contains("@"),
        "phone": digit,
        "api_key": F.col("content").rlike(r"(?U)(?i)(sk-|pk-|api)"),
        "ssn": digit,
        "credit_card": digit,
    }


def audit(df: DataFrame, preview_chars: int = 70) -> DataFrame:
    """``(id, label, preview, sensitive)``, one row per matching pattern."""
    guards = _guards()
    labels = F.array_compact(F.array(*[
        F.when(guards[label] & F.col("content").rlike(_java(p)), F.lit(label))
        for label, p in AUDIT_PATTERNS]))
    # explode() of an empty array emits nothing: no filter repeats the patterns.
    return (df.select("id", "content", "sensitive", labels.alias("_labels"))
            .select("id", F.explode("_labels").alias("label"),
                    F.substring("content", 1, preview_chars).alias("preview"), "sensitive"))


def audit_summary(issues: DataFrame, df: DataFrame) -> DataFrame:
    """``(metric, key, value)``: rows scanned, issues, per label, per
    sensitive flag.  Two small aggregates; no row reaches the driver."""
    scanned = df.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("rows_scanned").alias("metric"), F.lit(None).cast("string").alias("key"), "value")
    per = issues.groupingSets([[], ["label"], ["sensitive"]], "label", "sensitive").agg(
        F.count(F.lit(1)).alias("value"), F.grouping_id().alias("_g"))
    per = per.select(
        F.when(F.col("_g") == 3, F.lit("issues"))
         .when(F.col("_g") == 1, F.lit("by_label"))
         .otherwise(F.lit("by_sensitive")).alias("metric"),
        F.when(F.col("_g") == 1, F.col("label"))
         .when(F.col("_g") == 2, F.col("sensitive").cast("string")).alias("key"),
        "value")
    return scanned.unionByName(per)

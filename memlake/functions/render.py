"""Record rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def confidence_pct(col="confidence") -> Column:
    """Confidence as a whole percentage, half-even rounding (``85%``)."""
    return F.concat(F.bround(_c(col) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def _mark() -> Column:
    return F.when(F.col("sensitive"), F.lit(" [SENSITIVE]")).otherwise(F.lit(""))


def _columns(width: int) -> Column:
    """Source and category in columns of fixed width, then the first characters."""
    padded = lambda c, n: F.concat(F.col(c), F.repeat(F.lit(" "), F.greatest(F.lit(n) - F.length(c), F.lit(0))))
    return F.concat(F.lit("["), padded("source", 8), F.lit("] ["), padded("category", 12), F.lit("] "),
                    F.substring("content", 1, width), _mark())


def render_short(index, verbose: bool = False, as_of=None) -> Column:
    """List form: one line with 60 characters of content, numbered in three
    columns; ``verbose`` adds tags (if any), id and age in days."""
    number = _c(index).cast("string")
    line = F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(3) - F.length(number), F.lit(0))), number, F.lit(". "), _columns(60))
    if not verbose:
        return line
    from memlake.functions.timefn import age_days
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\n     Tags: "), F.array_join("tags", ", "))).otherwise(F.lit(""))
    return F.concat(line, tags, F.lit("\n     ID: "), F.col("id"), F.lit("  |  Age: "), age_days(as_of).cast("string"), F.lit("d"))


def render_hit(rank) -> Column:
    """Search form: 65 characters of content, then the tags (if any)."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\n   Tags: "), F.array_join("tags", ", "))).otherwise(F.lit(""))
    return F.concat(_c(rank).cast("string"), F.lit(". "), _columns(65), tags)


def render_line(index) -> Column:
    """Two-line rendering of one record, numbered by ``index``."""
    sens = _mark()
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise(F.lit("none"))
    return F.concat(
        _c(index).cast("string"), F.lit(". ["), F.upper("category"), F.lit("] "),
        F.col("content"), sens, F.lit("\n   Source: "), F.col("source"),
        F.lit(" | Confidence: "), confidence_pct(), F.lit(" | Tags: "), tags,
        F.lit(" | ID: "), F.col("id"),
    )

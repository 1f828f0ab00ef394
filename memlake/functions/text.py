"""Text expressions: trimming, word sets, full-text tokens, context lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's no-argument str.split() / str.strip()
# treat as whitespace, as a Java-regex character class body.
PY_WHITESPACE = (
    r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_RUN = f"[{PY_WHITESPACE}]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

# Full-text token characters: ASCII letters and digits plus every non-ASCII
# code point; everything else separates tokens.
FTS_SEPARATORS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Remove leading and trailing whitespace (Unicode, like Python's strip)."""
    return F.regexp_replace(_c(col), f"^{WS_RUN}|{WS_RUN}$", "")


def words(col) -> Column:
    """Lower-cased whitespace-separated words, empties dropped (keeps repeats)."""
    return F.array_remove(F.split(F.lower(_c(col)), WS_RUN), "")


def word_set(col) -> Column:
    """Distinct lower-cased words: the set used for near-duplicate Jaccard."""
    return F.array_distinct(words(col))


def ascii_fold(col) -> Column:
    """Lower-case ASCII letters only; other characters are kept as they are."""
    return F.translate(_c(col), _UPPER, _LOWER)


def fts_tokens(col) -> Column:
    """Full-text tokens of a string: ASCII-folded runs of token characters."""
    return F.array_remove(F.split(ascii_fold(col), FTS_SEPARATORS), "")


def context_line(category="category", content="content") -> Column:
    """``[CATEGORY] content`` (P5)."""
    return F.concat(F.lit("["), F.upper(_c(category)), F.lit("] "), _c(content))

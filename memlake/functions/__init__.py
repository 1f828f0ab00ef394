"""Column-level functions (JVM-side expressions, no Python UDFs)."""

from memlake.functions.text import (  # noqa: F401
    strip, word_set, ascii_fold, fts_tokens, context_line, PY_WHITESPACE,
)
from memlake.functions.classify import (  # noqa: F401
    classify, classify_frame, classify_scores, category_scores, extract_tags)  # noqa: F401
from memlake.functions.timefn import age_days, is_stale, parse_ts  # noqa: F401
from memlake.functions.render import render_line, confidence_pct  # noqa: F401

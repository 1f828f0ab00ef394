"""Porter stems (M. F. Porter, "An algorithm for suffix stripping", 1980) as SQL.

The rules are regular expressions and suffix tests on one column, a step a
projection, so Spark runs them inside the JVM and the same text runs on other
SQL engines (``stem_sql``).  They follow the widely used C rendition ("bli" ->
"ble", "logi" -> "log" in step 2); terms of fewer than 3 or more than 64 UTF-8
bytes pass unchanged, as in common full-text tokenizers.

Every byte of a non-ASCII character counts as a consonant there; a mark behind
each such character stands for its further bytes.  A leading ``y`` is a
consonant and written ``Y`` meanwhile.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_BYTES = 3
MAX_BYTES = 64

# The suffix lists of the published algorithm, in its order.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
         ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
         ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
         ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
         "ous", "ive", "ize"]

_MARK = "\uf8ff"
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME = f"^({_C})?{_V}{_C}"                     # measure above 0
_MORE = f"^({_C})?{_V}{_C}{_V}{_C}"             # measure above 1
_ONE = f"^({_C})?{_V}{_C}({_V})?$"              # measure 1
_VOWEL = f"^({_C})?[aeiouy]"
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"             # of a word of measure 1
_DOUBLE = "(" + "|".join(c * 2 for c in "0123456789bcdfghjklmnpqrstvwxz") + "|[^aeiouy](yy)+|[aeiou]y(yy)+)$"


def _ends(suffix: str) -> str:
    return f"right(w, {len(suffix)}) = '{suffix}'"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _steps(like: str, byte_length: str, marked: str) -> list[dict[str, str]]:
    """Columns of each step, computed from ``term`` and the step before."""
    def is_(x, pattern):
        return f"{like}({x}, '{pattern}')"

    def replaced(rules, least):
        cases = " ".join(f"WHEN {_ends(s)} THEN CASE WHEN {is_(_cut(len(s)), least)} THEN concat({_cut(len(s))}, '{r}') ELSE w END"
                         for s, r in rules)
        return f"CASE {cases} ELSE w END"

    eed = f"({_ends('eed')} AND length(w) > 3)"
    ed = f"({_ends('ed')} AND {is_(_cut(2), _VOWEL)})"
    ing = f"({_ends('ing')} AND {is_(_cut(3), _VOWEL)})"
    before_ion = "substr(w, length(w) - 3, 1) IN ('s', 't') AND length(w) > 3"
    step4 = " ".join(f"WHEN {_ends(s)}{f' AND {before_ion}' if s == 'ion' else ''} THEN "
                     f"CASE WHEN {is_(_cut(len(s)), _MORE)} THEN {_cut(len(s))} ELSE w END" for s in STEP4)
    return [
        {"w": f"CASE WHEN {byte_length}(term) BETWEEN {MIN_BYTES} AND {MAX_BYTES} THEN regexp_replace({marked}, '^y', 'Y') END"},
        {"w": f"CASE WHEN {_ends('sses')} AND length(w) > 4 OR {_ends('ies')} AND length(w) > 3 THEN {_cut(2)} "
              f"WHEN {_ends('s')} AND NOT {_ends('ss')} THEN {_cut(1)} ELSE w END"},
        {"fix": f"NOT {eed} AND ({ed} OR {ing})",
         "w": f"CASE WHEN {eed} THEN CASE WHEN {is_(_cut(3), _SOME)} THEN {_cut(1)} ELSE w END WHEN {ed} THEN {_cut(2)} WHEN {ing} THEN {_cut(3)} ELSE w END"},
        {"w": f"CASE WHEN NOT fix THEN w WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN concat(w, 'e') "
              f"WHEN {is_('w', _DOUBLE)} THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE {_cut(1)} END "
              f"WHEN {is_('w', _ONE)} AND {is_('w', _CVC)} THEN concat(w, 'e') ELSE w END"},
        {"w": f"CASE WHEN {_ends('y')} AND {is_(_cut(1), _VOWEL)} THEN concat({_cut(1)}, 'i') ELSE w END"},
        {"w": replaced(STEP2, _SOME)},
        {"w": replaced(STEP3, _SOME)},
        {"w": f"CASE {step4} ELSE w END"},
        {"w": f"CASE WHEN {_ends('e')} AND ({is_(_cut(1), _MORE)} OR ({is_(_cut(1), _ONE)} AND NOT {is_(_cut(1), _CVC)})) THEN {_cut(1)} ELSE w END"},
        {"w": f"CASE WHEN {_ends('ll')} AND {is_('w', _MORE)} THEN {_cut(1)} ELSE w END"},
        {"stem": f"CASE WHEN w IS NULL THEN term ELSE replace(replace(w, '{_MARK}', ''), 'Y', 'y') END"},
    ]


def with_stems(terms: DataFrame) -> DataFrame:
    """``terms`` (a column ``term``) with a column ``stem``."""
    out = terms.select("term")
    for step in _steps("regexp_like", "octet_length", f"regexp_replace(term, '([^\\\\x00-\\\\x7F])', '$1{_MARK}')"):
        last = "stem" in step
        out = out.selectExpr("term", *[f"{e} AS {c}" for c, e in step.items()])
        if last:
            return out


_FOUND = {p: re.compile(p) for p in (_SOME, _MORE, _ONE, _VOWEL, _CVC, _DOUBLE)}


def stem_word(term: str) -> str:
    """The stem of one term by the same rules, for rows whose tokens are in Python already."""
    if not MIN_BYTES <= len(term.encode()) <= MAX_BYTES:
        return term

    def is_(x, pattern):
        return _FOUND[pattern].search(x) is not None
    w = re.sub("^y", "Y", re.sub("([^\x00-\x7f])", r"\1" + _MARK, term))
    if w.endswith("sses") and len(w) > 4 or w.endswith("ies") and len(w) > 3:
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    fix = False
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if is_(w[:-3], _SOME) else w
    elif w.endswith("ed") and is_(w[:-2], _VOWEL):
        w, fix = w[:-2], True
    elif w.endswith("ing") and is_(w[:-3], _VOWEL):
        w, fix = w[:-3], True
    if fix:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif is_(w, _DOUBLE):
            w = w if w[-1] in "lsz" else w[:-1]
        elif is_(w, _ONE) and is_(w, _CVC):
            w += "e"
    if w.endswith("y") and is_(w[:-1], _VOWEL):
        w = w[:-1] + "i"
    for rules, least in ((STEP2, _SOME), (STEP3, _SOME), ([(s, "") for s in STEP4], _MORE)):
        for suffix, new in rules:
            if w.endswith(suffix) and (suffix != "ion" or len(w) > 3 and w[-4] in "st"):
                cut = w[:len(w) - len(suffix)]
                w = cut + new if is_(cut, least) else w
                break
    if w.endswith("e") and (is_(w[:-1], _MORE) or is_(w[:-1], _ONE) and not is_(w[:-1], _CVC)):
        w = w[:-1]
    if w.endswith("ll") and is_(w, _MORE):
        w = w[:-1]
    return w.replace(_MARK, "").replace("Y", "y")


def stem_sql(terms: str) -> str:
    """A DuckDB query (term, stem) over the query ``terms`` with a column term."""
    for step in _steps("regexp_matches", "strlen", f"regexp_replace(term, '([^\\x00-\\x7F])', '\\1{_MARK}', 'g')"):
        columns = ", ".join(f"{e} AS {c}" for c, e in step.items())
        terms = f"SELECT term, {columns} FROM ({terms})"
    return terms

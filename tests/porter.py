"""Porter stemming (M. F. Porter, "An algorithm for suffix stripping", 1980).

A small per-term helper, applied through ``stem_terms`` (a pandas UDF) to the
*distinct* vocabulary only; stems are then joined back to the postings.
Follows the widely used C rendition of the algorithm ("bli" -> "ble",
"logi" -> "log" in step 2).  Terms shorter than 3 or longer than 64 bytes
pass through unchanged, as in common full-text tokenizers.  The rules work
on the UTF-8 bytes, so every non-ASCII byte counts as a consonant.
"""

from __future__ import annotations

MIN_BYTES = 3
MAX_BYTES = 64

_VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(w: str, end: int) -> int:
    """Number of VC sequences in w[:end]."""
    n, i = 0, 0
    while i < end and _cons(w, i):
        i += 1
    while i < end:
        while i < end and not _cons(w, i):
            i += 1
        if i >= end:
            break
        n += 1
        while i < end and _cons(w, i):
            i += 1
    return n


def _has_vowel(w: str, end: int) -> bool:
    return any(not _cons(w, i) for i in range(end))


def _double_cons(w: str, end: int) -> bool:
    return end >= 2 and w[end - 1] == w[end - 2] and _cons(w, end - 1)


def _cvc(w: str, end: int) -> bool:
    i = end - 1
    if i < 2 or not _cons(w, i) or _cons(w, i - 1) or not _cons(w, i - 2):
        return False
    return w[i] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _by_penultimate(rules):
    groups: dict[str, list] = {}
    for r in rules:
        suf = r[0] if isinstance(r, tuple) else r
        groups.setdefault(suf[-2], []).append(r)
    return groups


_STEP2_G = _by_penultimate(_STEP2)
_STEP3_G = _by_penultimate(_STEP3)
_STEP4_G = _by_penultimate(_STEP4)


def _replace_group(w: str, groups, min_m: int) -> str:
    if len(w) < 2:
        return w
    for suf, rep in groups.get(w[-2], []):
        if w.endswith(suf):
            stem = len(w) - len(suf)
            return w[:stem] + rep if _measure(w, stem) > min_m else w
    return w


def _step1ab(w: str) -> str:
    if w.endswith("s"):
        # The two longer endings need a letter before them, as in the C rendition.
        if w.endswith("sses") and len(w) > 4:
            w = w[:-2]
        elif w.endswith("ies") and len(w) > 3:
            w = w[:-2]
        elif not w.endswith("ss"):
            w = w[:-1]
    if w.endswith("eed") and len(w) > 3:
        if _measure(w, len(w) - 3) > 0:
            w = w[:-1]
        return w
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w, len(w) - len(suf)):
            w = w[:-len(suf)]
            if w.endswith("at") or w.endswith("bl") or w.endswith("iz"):
                return w + "e"
            # A doubled byte of a longer character is no doubled letter: cutting it would leave half a character.
            if _double_cons(w, len(w)) and w[-1] < "\x80":
                return w if w[-1] in "lsz" else w[:-1]
            if _measure(w, len(w)) == 1 and _cvc(w, len(w)):
                return w + "e"
            return w
        if w.endswith(suf):
            return w
    return w


def _step4(w: str) -> str:
    if len(w) < 2:
        return w
    for suf in _STEP4_G.get(w[-2], []):
        if w.endswith(suf):
            stem = len(w) - len(suf)
            if suf == "ion" and not (stem > 0 and w[stem - 1] in "st"):
                continue
            return w[:stem] if _measure(w, stem) > 1 else w
    return w


def _step5(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w, len(w) - 1)
        if m > 1 or (m == 1 and not _cvc(w, len(w) - 1)):
            w = w[:-1]
    if w.endswith("l") and _double_cons(w, len(w)) and _measure(w, len(w)) > 1:
        w = w[:-1]
    return w


def stem_ascii(w: str) -> str:
    """Stem one lower-case word given as a byte-per-character string."""
    if len(w) <= 2:
        return w
    w = _step1ab(w)
    if w.endswith("y") and _has_vowel(w, len(w) - 1):
        w = w[:-1] + "i"
    w = _replace_group(w, _STEP2_G, 0)
    w = _replace_group(w, _STEP3_G, 0)
    w = _step4(w)
    return _step5(w)


def stem(term: str) -> str:
    """Stem a token; tokens outside 3..64 UTF-8 bytes are returned as is."""
    if term is None:
        return None
    raw = term.encode("utf-8")
    if len(raw) < MIN_BYTES or len(raw) > MAX_BYTES:
        return term
    out = stem_ascii(raw.decode("latin-1")).encode("latin-1")
    try:
        return out.decode("utf-8")
    except UnicodeDecodeError:      # never cut a character in half
        return term

"""Brute-force versions of the operators' contracts, and shared rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Further columns whose names an operator could use itself.
CLASHING = ["spots", "b", "x", "w", "hash", "start", "label", "learn", "kinds", "pieces_0", "matches_0", "comp", "count"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    chance = random.Random(seed)
    return " ".join(f"w{chance.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows):
    """``rows``: (doc_id, text) or (doc_id, text, lang); the clashing columns hold nulls and texts in turn."""
    full = []
    for i, r in enumerate(rows):
        doc_id, text, lang = (*r, None)[:3]
        full.append((doc_id, text, lang, *((None if (i + j) % 3 == 0 else f"v{j}") for j in range(len(CLASHING)))))
    return spark.createDataFrame(full, SCHEMA)


def awkward() -> list[tuple]:
    """Null, empty, blank, very long and repeated texts; a null id; a repeated row."""
    long = prose(1, 30_000, 5000)
    same = prose(2, 120)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, same), (6, same), (7, prose(3, 30) + "\n" + same), (8, "be " * 300),
            (9, "é" * 500), (None, same), (10, prose(4, 80)), (10, prose(4, 80)), (11, "one"), (12, "a b c"), (13, same[:-3] + "zz")]


def removed_words(rows, length=50):
    """doc_id -> (n_words, n_removed, kept_sha256); rows with a null id are left out."""
    words = {i: (t or "").encode().split() for i, t in rows if i is not None}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][s:s + length]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s:s + length])] < i:
                gone.update(range(s, s + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def removed_bytes(rows, length=200):
    """Per row (doc_id, text): (n_bytes, n_removed, n_spans, kept_sha256)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter()
    for i, b in texts:
        if i is not None:
            seen.update(b[s:s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if i is not None and seen[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return out


def contaminated(rows, items, length=13):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM_WORD.findall((text or "").translate(FOLD))
        n = min(length, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s:s + n])].add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for i, text in rows:
        w, hit, found = ALNUM_WORD.findall((text or "").translate(FOLD)), set(), set()
        for n in lengths if i is not None else ():
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def quality_base(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    count = collections.Counter(tuple(w[s:s + 5]) for s in range(len(w) - 4))
    again = set()
    for s in range(len(w) - 4):
        if count[tuple(w[s:s + 5])] > 1:
            again.update(range(s, s + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again),
            len(w) < 10 or 100 * len(again) > 20 * len(w))

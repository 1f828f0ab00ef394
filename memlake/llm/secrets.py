r"""Operator 1, secret scan with character Markov models.

Base patterns (leftmost, non-overlapping, for each kind on its own):

* ``assign``: a password, secret, token or API key name, ``:`` or ``=``, and a
  value of 12 characters or more; the span is the whole match;
* ``access``: ``AKIA`` and capitals or digits, 18 characters or more;
* ``hex``: lower-case hex digits, 16 or more.

The method adds spans of kind ``random``: runs of ``[A-Za-z0-9+/_=-]`` of at
least ``least_run`` characters that touch no base span and whose characters
are likelier under a first-order Markov model of random strings than under one
of ordinary identifiers: the log-likelihood ratio must reach ``least_ratio``
nats in all and ``least_mean`` a character, and there must be a letter and a
digit.  Runs in capitals only are read in lower case.

Both models are trained from labelled samples: values inside base spans are
random, runs of 4 or more characters outside base spans are ordinary.
Each sample comes from at most ``sample_docs`` documents (the smallest hashes of
their ids), a bound that keeps training small at any corpus size; what reaches
the driver are transition counts, at most 2 x 66 x 66 rows.  The scan reads
whole texts of all rows, and is one projection without any shuffle.

Positions are code points, ends exclusive.  Spark's functions give matches but
not their places, so a place is the summed length of the pieces between
matches and of the matches before it.

Defined cases: null and empty texts have no spans; repeated rows are scanned
each; two kinds that start together are listed as assign, access, hex, random;
without samples of either label nothing is added; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, id_text, staged

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"       # runs are matched whole, so the length may stand in the pattern
HEX = r"[0-9a-f]{16,}"
_NONE = "cast(array() as array<struct<start: int, end: int, value: string>>)"


def _places(text: str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern: struct(start, end, value); value is a group."""
    lit = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    # Fields of the zipped rows: 0 the piece before a match, 1 the match, 2 its group.
    return F.expr(f"""if({text} rlike {lit}, aggregate(
        arrays_zip(split({text}, {lit}, -1), regexp_extract_all({text}, {lit}, 0), regexp_extract_all({text}, {lit}, {group})),
        named_struct('at', 0, 'found', {_NONE}),
        (a, m) -> named_struct('at', a.at + length(m.`0`) + coalesce(length(m.`1`), 0), 'found',
            if(m.`1` is null, a.found, concat(a.found, array(named_struct('start', a.at + length(m.`0`),
                'end', a.at + length(m.`0`) + length(m.`1`), 'value', m.`2`))))),
        a -> a.found), {_NONE})""")


def _with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base spans of each kind."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return (docs.withColumn("assign", F.filter(_places("text", ASSIGN, 2), lambda s: F.length(s["value"]) >= 12))
            .withColumn("access", _places("text", ACCESS)).withColumn("hex", _places("text", HEX)))


def _runs(least: int) -> Column:
    """Runs of at least ``least`` characters that touch no base span."""
    return F.expr(f"""filter(runs, r -> r.end - r.start >= {least}
        and not exists(assign, b -> b.start < r.end and r.start < b.end)
        and not exists(access, b -> b.start < r.end and r.start < b.end)
        and not exists(hex, b -> b.start < r.end and r.start < b.end))""")


def _codes(value: str) -> str:
    return f"transform(split(if({value} = upper({value}), lower({value}), {value}), ''), c -> ascii(c))"


def _run_places(least: int) -> Column:
    return _places("text", "[A-Za-z0-9+/_=-]{%d,}" % least)


def train(docs: DataFrame, sample_docs: int = 2000) -> dict[tuple[int, int], float] | None:
    """Log-likelihood ratio of each transition (two character codes): random
    against ordinary; None without samples of both labels."""
    rank = [F.xxhash64("doc_id"), F.col("doc_id")]
    docs = docs.where("text is not null")
    any_secret = F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)
    with_secret = docs.where(any_secret).select("doc_id").orderBy(*rank).limit(sample_docs)
    plain = docs.select("doc_id").orderBy(*rank).limit(sample_docs)
    chosen = staged(with_secret.withColumn("random", F.lit(True)).unionByName(plain.withColumn("random", F.lit(False))),
                    "op1-sample")                      # at most 2 * sample_docs ids
    sample = docs.join(F.broadcast(chosen), "doc_id")
    random = (_with_base(sample.where("random")).select(F.explode(F.flatten(F.array("assign", "access", "hex"))).alias("s"))
              .select("s.value"))
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = sample.where("not random").select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("value"))
    both = random.withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False)))
    pairs = (both.select("random", F.expr(_codes("value")).alias("c"))
             .select("random", F.explode(F.expr(
                 "if(size(c) < 2, array(), transform(sequence(1, size(c) - 1), i -> named_struct('a', c[i - 1], 'b', c[i])))")).alias("p"))
             .where("p.a < 128 and p.b < 128").groupBy("random", "p.a", "p.b").count())
    counts: dict[bool, dict] = {True: {}, False: {}}
    rows = pairs.collect()
    dropped(chosen)
    for r in rows:
        counts[r["random"]][r["a"], r["b"]] = r["count"]
    if not counts[True] or not counts[False]:
        return None
    signs = [*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_=-")]

    def chances(seen: dict) -> dict:
        """Add-one smoothing, rows backed by the overall share of a sign."""
        share = {b: 1 / len(signs) for b in signs}
        total = sum(seen.values()) + len(signs)
        for b in signs:
            share[b] = (1 + sum(seen.get((a, b), 0) for a in signs)) / total
        made = {}
        for a in signs:
            row = sum(seen.get((a, b), 0) for b in signs)
            for b in signs:
                made[a, b] = (seen.get((a, b), 0) + 32 * share[b]) / (row + 32)
        return made

    random_p, ordinary_p = chances(counts[True]), chances(counts[False])
    # Random strings of other alphabets than the sampled ones: never below an even draw of the signs.
    return {k: math.log(max(p, 1 / len(signs)) / ordinary_p[k]) for k, p in random_p.items()}


def scan(docs: DataFrame, ratios: dict[tuple[int, int], float] | None, least_run: int = 20, least_ratio: float = 15.0,
         least_mean: float = 1.5) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_random and found (kind, start, end of every span)."""
    docs = _with_base(docs)
    random = F.expr(_NONE)
    if ratios is not None:
        table = ",".join(f"{ratios.get((a, b), 0.0):.6f}" for a in range(128) for b in range(128))
        # One text literal, folded to an array of 128 x 128 numbers when the plan is optimised.
        docs = docs.withColumn("runs", _run_places(least_run)).withColumn("runs", _runs(least_run))
        sums = f"""transform(runs, r -> aggregate({_codes('r.value')},
            named_struct('last', -1, 'sum', 0D),
            (a, c) -> named_struct('last', c, 'sum', a.sum + if(a.last < 0, 0D,
                get(cast(split('{table}', ',') as array<double>), a.last * 128 + c))), a -> a.sum))"""
        docs = docs.withColumn("sums", F.expr(f"if(size(runs) = 0, cast(array() as array<double>), {sums})"))
        random = F.expr(f"""filter(runs, (r, i) -> sums[i] >= {least_ratio}
            and r.value rlike '[0-9]' and r.value rlike '[A-Za-z]' and sums[i] >= {least_mean} * (length(r.value) - 1))""")
    docs = docs.withColumn("random", random)

    def named(kind: str, order: int) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("turn"),
                                                     s["end"].alias("end"), F.lit(kind).alias("kind")))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.concat(named("assign", 0), named("access", 1), named("hex", 2))
    every = F.concat(base, named("random", 3))
    return docs.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
        F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                            s["end"].alias("end"))).alias("found"))


def secret_scan(docs: DataFrame, sample_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    docs = id_text(docs, id_col, text_col)
    return scan(docs, train(docs, sample_docs), **limits)

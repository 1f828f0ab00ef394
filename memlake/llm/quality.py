r"""Operator 7, quality rules by distribution divergence.

Every document has two histograms: its characters by class (capitals, digits,
symbols ``#*$%&|<>``, other ASCII marks, white space, the further bytes of
non-ASCII characters, and all others, mostly small letters), and its words over the ``common`` most frequent words of its
language, plus all others.  Both are compared with the same histogram summed
over all documents of the language (the reference) by Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1).  A document is rejected if

* it has at least ``least_chars`` characters and its character distance is over
  ``most_char``, or
* it has at least ``least_words`` words and its word distance is over
  ``most_word``; shorter ones say too little and are let through (the guards);

or if it fails the base rules: fewer than 10 words, or more than a fifth of its
words inside 5-word windows found twice or more in the text.

References are counted over all rows of a language with at least
``least_docs`` documents that pass the base rules, for all languages; for a
document of another language the base rules alone decide.  A document whose
language is null is compared with the reference that fits best.
Common words are counted over all rows too, among words of every length.

Two passes over the texts, with short keys and partial sums in every shuffle;
the counts of a document are written once and read by what follows.

Defined cases: null and empty texts have no words and fail the base rules;
without any reference the base rules alone decide; words of equal frequency
are ranked by their bytes; repeated rows each count; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, staged

_SPACE = r"[\x20\x09-\x0D]"
_CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "other": r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~\x00-\x08\x0E-\x1F\x7F]"""}
#: Counted classes, then: white space, bytes that non-ASCII characters need beyond one, all other characters.
_N_CLASSES = len(_CLASSES) + 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE + "+", -1), "")


def _matches(text: Column, pattern: str) -> Column:
    """Number of one-character matches (splitting is the fastest way to count)."""
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def common_words(docs: DataFrame, common: int = 16) -> DataFrame:
    """(lang, common): the most frequent words of each language."""
    seen = (docs.where("lang is not null").select("lang", F.explode(words(F.col("text"))).alias("word"))
            .groupBy("lang", "word").count())
    turn = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    return (seen.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= common)
            .groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("common")))


def _repeat_words(length: int = 5) -> list[tuple[str, Column]]:
    """Steps that lead to n_repeat_words, from the column w."""
    behind = ", ".join(f"get(hw, i + {k})" for k in range(1, length))
    return [
        ("hw", F.expr("transform(w, x -> xxhash64(x))")),
        ("h", F.expr(f"if(size(hw) < {length}, cast(array() as array<bigint>), "
                     f"slice(transform(hw, (x, i) -> xxhash64(x, {behind})), 1, size(hw) - {length - 1}))")),
        # Only texts with a repeat (fewer distinct hashes) are sorted.
        ("hs", F.expr("if(size(array_distinct(h)) = size(h), cast(array() as array<struct<h: bigint, at: int>>), "
                      "sort_array(transform(h, (x, i) -> named_struct('h', x, 'at', i))))")),
        ("starts", F.expr("sort_array(transform(filter(hs, (s, i) -> s.h = get(hs, i - 1).h or s.h = get(hs, i + 1).h), s -> s.at))")),
        ("n_repeat_words", F.expr(f"aggregate(starts, named_struct('last', -{length}, 'sum', 0L), (a, p) -> "
                                  f"named_struct('last', p, 'sum', a.sum + least({length}, p - a.last)), a -> a.sum)")),
    ]


def measured(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Base counts and histograms of each document; ``docs`` has doc_id, text,
    lang; ``common`` is a small table, a row for each language.  A document
    watches the words of its language, or of all languages if that is null."""
    every = common.agg(F.lit(None).cast("string").alias("of"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("common")))).alias("watch"))
    watches = common.select(F.col("lang").alias("of"), F.col("common").alias("watch")).unionByName(every)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = (docs.select("doc_id", "lang", text.alias("text")).join(F.broadcast(watches), F.col("lang").eqNullSafe(F.col("of")), "left")
          .withColumn("watch", F.coalesce("watch", F.array().cast("array<string>"))).withColumn("w", words(F.col("text"))))
    for name, step in _repeat_words():
        df = df.withColumn(name, step)
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = {f"c_{k}": _matches(F.col("text"), p) for k, p in _CLASSES.items()}
    df = df.withColumn("lines", lines)
    # The watched words alone, each between two spaces of its own: how often one
    # occurs is how much shorter the text gets without it.
    df = df.withColumn("watched", F.concat(F.lit(" "), F.array_join(F.filter("w", lambda x: F.array_contains("watch", x)), "  "), F.lit(" ")))
    seen = F.transform("watch", lambda v: F.floor((F.octet_length("watched") - F.octet_length(
        F.replace("watched", F.concat(F.lit(" "), v, F.lit(" ")), F.lit("")))) / (F.octet_length(v) + 2)).cast("bigint"))
    df = df.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"), F.size("w").cast("long").alias("n_words"),
                   F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
                   *(c.alias(k) for k, c in counts.items()),
                   "watch", seen.alias("seen"))
    classes = [F.col(f"c_{k}") for k in _CLASSES]
    letters = F.col("word_chars")
    for c in classes:
        letters = letters - c
    classes += [F.col("n_chars") - F.col("word_chars"), F.col("n_bytes") - F.col("n_chars"), letters]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.select("doc_id", "lang", "n_chars", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines",
                     "n_repeat_words", failed.alias("base_failed"), F.array(*classes).alias("chars"),
                     F.map_from_arrays("watch", "seen").alias("seen"))


def _distance(p: str, q: str) -> str:
    """SQL of the Jensen-Shannon distance of two count arrays; null without
    counts.  One-element arrays bind what is used more than once, so that
    nothing is evaluated again for each element."""
    term = "if({0} <= 0, 0D, {0} * ln(2 * {0} / ({0} + {1})))"
    total = "aggregate({0}, 0D, (t, x) -> t + x)"
    return f"""transform(transform(array(named_struct('p', {p}, 'q', {q})), y -> named_struct(
        'p', y.p, 'q', y.q, 'sp', {total.format('y.p')}, 'sq', {total.format('y.q')})), z ->
        if(z.sp = 0 or z.sq = 0, null, sqrt(greatest(0D, aggregate(zip_with(z.p, z.q,
        (a, b) -> named_struct('a', a / z.sp, 'b', b / z.sq)), 0D,
        (t, v) -> t + {term.format('v.a', 'v.b')} + {term.format('v.b', 'v.a')}) / (2 * ln(2D))))))[0]"""


def references(counts: DataFrame, common: DataFrame, least_docs: int = 20) -> DataFrame:
    """(ref_lang, common, ref_chars, ref_words): sums over all documents of a language that pass the base rules."""
    good = counts.where("lang is not null and not base_failed")
    sums = good.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("all_words"),
                                    F.array(*(F.sum(F.col("chars")[i]) for i in range(_N_CLASSES))).alias("ref_chars"))
    seen = (good.select("lang", F.explode("seen").alias("word", "k")).groupBy("lang", "word").agg(F.sum("k").alias("k"))
            .groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "k"))).alias("ref_seen")))
    ref = sums.where(F.col("n_docs") >= least_docs).join(seen, "lang").join(common, "lang")
    return ref.select(F.col("lang").alias("ref_lang"), "common", "ref_chars",
                      F.expr(_over_common("common", "ref_seen", "all_words")).alias("ref_words"))


def _over_common(common: str, seen: str, total: str) -> str:
    """SQL of the counts of the common words, and of all other words."""
    listed = f"transform({common}, c -> coalesce(try_element_at({seen}, c), 0L))"
    return f"concat({listed}, array({total} - aggregate({listed}, 0L, (a, x) -> a + x)))"


def judge(docs: DataFrame, least_chars: int = 200, most_char: float = 0.3, least_words: int = 50, most_word: float = 0.42,
          least_docs: int = 20, common: int = 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, char_distance,
    word_distance."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    shared = staged(common_words(docs, common), "op7-common")
    counts = staged(measured(docs, shared), "op7-counts")
    refs = staged(references(counts, shared, least_docs), "op7-references")
    dropped(shared)
    one = F.struct(*refs.columns)
    every = refs.agg(F.lit(None).cast("string").alias("of"), F.collect_list(one).alias("own"))
    own = refs.select(F.col("ref_lang").alias("of"), F.array(one).alias("own")).unionByName(every)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # A reference is one row a language, of fixed width.
    df = counts.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("of")), "left")
    fits = f"""transform(own, r -> named_struct('c', {_distance('chars', 'r.ref_chars')},
        'w', {_distance(_over_common('r.common', 'seen', 'n_words'), 'r.ref_words')}))"""
    df = df.withColumn("fits", F.expr(fits)).withColumn(
        "best", F.array_min(F.transform("fits", lambda f: F.struct((F.coalesce(f["c"], F.lit(0.0)) + F.coalesce(f["w"], F.lit(0.0))).alias("sum"),
                                                                   f["c"].alias("c"), f["w"].alias("w")))))
    far = (((F.col("n_chars") >= least_chars) & (F.coalesce("best.c", F.lit(0.0)) > most_char))
           | ((F.col("n_words") >= least_words) & (F.coalesce("best.w", F.lit(0.0)) > most_word)))
    return df.select(*base, (~F.col("base_failed") & ~far).alias("kept"), F.col("best.c").alias("char_distance"),
                     F.col("best.w").alias("word_distance"))

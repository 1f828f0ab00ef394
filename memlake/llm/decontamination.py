r"""Operator 5, benchmark decontamination with a broadcast hash set.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower
case.  A window is ``length`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window.  All windows of a text are hashed in
one projection and looked up in the set of benchmark window hashes; hits are
verified word for word before they count.  A text word inside any occurrence
of a benchmark window is hit.

The set holds one 8-byte hash for each benchmark window and is broadcast only
if a count proves it at most ``most_broadcast`` rows (16 MB at the default);
beyond that the lookup is a plain shuffle join on the hash.

Defined cases: null and empty texts have no words, no hits and are clean; null
and empty items have no windows; repeated items each count by their item id;
rows that share a doc_id are one document and must hold the same text; null
ids never join and are returned as clean; further columns are ignored; with an
empty benchmark all rows are clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, staged

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text (splitting is several times faster than extracting)."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, _BETWEEN, -1), "")


def _hashes(words_col: str, length: int) -> Column:
    """Hashes of all windows of ``length`` words, by start."""
    return F.expr(f"if(size({words_col}) < {length}, array(), "
                  f"transform(sequence(1, size({words_col}) - {length - 1}), i -> xxhash64(slice({words_col}, i, {length}))))")


def benchmark_windows(items: DataFrame, length: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, n, window, item_id) of all windows of all items."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    w = w.withColumn("n", F.least(F.size("w"), F.lit(length)))
    w = w.select("item_id", "n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))")).alias("window"))
    return w.select(F.xxhash64("window").alias("hash"), "n", "window", "item_id").distinct()


def hits(docs: DataFrame, windows: DataFrame, most_broadcast: int = 2_000_000) -> DataFrame:
    """Verified hits (doc_id, start, n, item_id) of the benchmark windows;
    ``docs`` has doc_id and text, starts count from 1."""
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())     # at most ``length`` numbers
    keys = windows.select("hash").distinct()
    docs = docs.where("doc_id is not null")
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    # The word array stays in the lookup's stage: only the few rows found take their window out of it.
    small = keys.count() <= most_broadcast
    carried = ["doc_id", "w"] if small else ["doc_id"]
    keys = F.broadcast(keys) if small else keys
    found = w.select("doc_id", F.lit(1).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("hash"),
                     F.col("w").alias("window")).where("false")
    for n in lengths:
        looked_up = w.select(*carried, F.posexplode(_hashes("w", n)).alias("at", "hash")).join(keys, "hash", "left_semi")
        looked_up = looked_up.select(*carried, (F.col("at") + 1).alias("start"), F.lit(n).alias("n"), "hash")
        if not small:
            starts = looked_up.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "hash")).alias("s"))
            looked_up = w.join(starts, "doc_id").select("doc_id", "w", F.inline("s"))
        found = found.unionByName(looked_up.select("doc_id", "start", "n", "hash", F.slice("w", F.col("start"), n).alias("window")))
    # Word-for-word check against the benchmark windows of the same hash.
    return found.join(windows, ["hash", "n", "window"]).select("doc_id", "start", "n", "item_id")


def contamination(docs: DataFrame, items: DataFrame, length: int = 13, least_share: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", most_broadcast: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated (n_hit > 0 and least_share * n_hit >= n_words), and hit_spans
    (start, end word, end exclusive, from 0)."""
    docs = id_text(docs, id_col, text_col)
    windows = staged(benchmark_windows(items, length), "op5-benchmark")
    # Occurrences of a document, then its covered words as a union of spans.
    spots = hits(docs, windows, most_broadcast).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start"), F.col("n")))).alias("spots"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    merged = F.expr("""aggregate(spots, cast(array() as array<struct<start: int, end: int>>), (done, s) ->
        if(size(done) > 0 and element_at(done, -1).end >= s.start - 1,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start,
                                                                     'end', greatest(element_at(done, -1).end, s.start - 1 + s.n)))),
           concat(done, array(named_struct('start', s.start - 1, 'end', s.start - 1 + s.n)))))""")
    spots = spots.select("doc_id", "items", merged.alias("hit_spans"))
    sizes = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = sizes.join(spots, "doc_id", "left")
    n_hit = F.coalesce(F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)"), F.lit(0))
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (least_share * n_hit >= F.col("n_words"))).alias("contaminated"), "hit_spans")


def without_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) with the hit words of contaminated documents cut
    out of the text, what stands between words left as it is; ``found`` comes
    from ``contamination``."""
    cut = found.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("hit_spans").alias("__spans"))
    text = F.col(text_col)
    pieces = F.split(text, r"[0-9A-Za-z\x{80}-\x{10FFFF}]+", -1)
    kept = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    joined = docs.join(cut, F.col(id_col) == F.col("__id"), "left").withColumn("__gaps", pieces).withColumn("__words", kept)
    rebuilt = F.expr("""concat(element_at(__gaps, 1), array_join(transform(__words, (w, i) -> concat(
        if(exists(__spans, s -> i >= s.start and i < s.end), '', w), element_at(__gaps, i + 2))), ''))""")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(rebuilt)).select(*docs.columns)

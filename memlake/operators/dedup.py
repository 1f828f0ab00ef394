"""Exact and near-duplicate detection.

Exact content matching joins on a SHA-256 of the text (32-byte keys in the
shuffle, never whole texts).  Near duplicates are an exact set-similarity
self-join with prefix filtering:

1. each row's word set (lower-cased, whitespace split, distinct);
2. rows with identical word sets collapse to one representative (the newest)
   with a copy count -- partial aggregation, so a hot group of copies is
   reduced map-side and never expands to all pairs;
3. words are ordered globally rare-first (by the count of their hash class,
   of 2^20, over representatives); each set keeps its first
   ``n - ceil(t*n) + 1`` words as its prefix -- any pair with Jaccard >= t
   shares a prefix word;
4. prefixes meet by word (length filter ``min >= t*max``, bounds on the
   overlap by place and by sketch), candidates are de-duplicated and the words
   of each are counted where the sets of a family meet.

The output is lossless: pairs between distinct word sets carry both copy
counts, and ``duplicate_copies`` links every other copy to its
representative (n-1 rows per group, linear).  ``pair_count`` gives the exact
number of row pairs the pairwise definition would list.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import meets
from memlake.functions.text import word_set
from memlake.operators.filters import content_key
from memlake.util import drop_materialized, materialize

EPS = 1e-9
#: Words and pairs of a bucket, about, and buckets at least.
ROWS, WORDS, LEAST = 1 << 21, 1 << 21, 16
#: Sets near one set that are cut into blocks beyond this; slots of a set of numbers.
BLOCK, SLOTS = 1 << 10, 1 << 21


# ------------------------------------------------------------- exact

def dedup_batch(incoming: DataFrame, order_cols=("file", "pos"), by: list[str] | None = None) -> DataFrame:
    """Keep the first row (by ``order_cols``) of each distinct content.

    ``min(struct(order..., row...))`` is a partial aggregate, so a text repeated
    in a third of the batch is reduced map-side before the shuffle.
    """
    by = list(by or [])
    cols = incoming.columns
    keyed = incoming.withColumn("_ck", content_key())
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                      *[F.col(c) for c in cols])
    first = keyed.groupBy(*by, "_ck").agg(F.min(packed).alias("_r"))
    return first.select(*[F.col("_r")[c].alias(c) for c in cols])


def new_rows(table: DataFrame, incoming: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Incoming rows whose content is not stored yet (per scope ``by``).
    ``table`` may be a key table (a column ``content_key`` instead of the texts):
    then the few keys of the batch go to it, and it is not shuffled."""
    by = list(by or [])
    if "content" not in table.columns:
        keyed = incoming.withColumn("_ck", content_key())
        known = (table.select(*by, F.col("content_key").alias("_ck"))
                 .join(keyed.select(*by, "_ck").distinct(), by + ["_ck"], "left_semi"))
        return keyed.join(known, by + ["_ck"], "left_anti").drop("_ck")
    # No distinct on the stored keys: both sides are then plain shuffles, and AQE
    # splits the partition of a text that many incoming rows repeat.
    stored = table.select(*by, content_key().alias("_ck"))
    return (incoming.withColumn("_ck", content_key())
            .join(stored, by + ["_ck"], "left_anti").drop("_ck"))


def check_keys(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """D3: ids that would occur more than once after appending ``incoming``."""
    ids = table.select("id").unionAll(incoming.select("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


# --------------------------------------------------------- near duplicates --

def _newest_key() -> F.Column:
    # Smallest = newest (created_at desc), then id asc.
    return F.struct((-F.unix_micros("created_at")).alias("t"), F.col("id").alias("id"))


def word_sets(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(…by, id, created_at, words, set_key)``; empty sets share one key."""
    by = list(by or [])
    ws = df.select(*by, "id", "created_at", word_set("content").alias("words"))
    return ws.withColumn("set_key", F.sha2(F.array_join(F.sort_array("words"), " "), 256))


def copy_groups(ws: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per distinct word set: representative (newest) and copy count."""
    by = list(by or [])
    g = ws.groupBy(*by, "set_key").agg(
        F.min(F.struct(_newest_key().alias("k"), F.col("created_at"))).alias("_rep"),
        F.count(F.lit(1)).alias("copies"),
        F.any_value("words").alias("words"))
    out = g.select(*by, "set_key", F.col("_rep.k.id").alias("rep_id"),
                   F.col("_rep.created_at").alias("rep_created_at"), "copies", "words",
                   F.size("words").alias("n_words"))
    return out.filter(F.col("n_words") > 0)


def duplicate_copies(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(…by, rep_id, id)``: each row whose word set equals a newer row's,
    linked to the newest row with that set."""
    by = list(by or [])
    ws = word_sets(df, by)
    # The group table is written first, so both join sides are plain shuffles
    # and AQE can split the partition of a hot group of copies.
    groups = materialize(copy_groups(ws, by).filter(F.col("copies") > 1).select(*by, "set_key", "rep_id"), "copies")
    return (ws.join(groups, by + ["set_key"]).filter(F.col("id") != F.col("rep_id"))
            .select(*by, "rep_id", "id"))


def _hashes(by: list[str]) -> F.Column:
    """A 64-bit hash of each word (and its scope) of a set."""
    return F.transform(F.split("text", " "), lambda w: F.xxhash64(*by, w))


def _class_counts(groups: DataFrame, by: list[str]) -> np.ndarray:
    """How often the words of each hash class occur in the sets; 2^20 numbers
    whatever the input."""
    sums = (groups.select(_hashes(by).alias("words")).mapInArrow(meets.slots, "slot long, df long")
            .groupBy("slot").agg(F.sum("df").alias("df")).toArrow())
    counts = np.zeros(1 << meets.CLASS_BITS, np.int64)
    counts[sums.column("slot").to_numpy()] = sums.column("df").to_numpy()
    return counts


def _slots(gids: DataFrame) -> np.ndarray:
    """Which of ``SLOTS`` slots hold a number of the column."""
    found = gids.mapInArrow(meets.number_slots(SLOTS), "slot long").distinct().toArrow()
    held = np.zeros(SLOTS, bool)
    held[found.column("slot").to_numpy()] = True
    return held


def _candidates(groups: DataFrame, counts: np.ndarray, threshold: float, by: list[str], probes: np.ndarray | None) -> DataFrame:
    """``(ka, kb)``, numbers of the sets of pairs that may pass.

    The prefix of a set is made where the set is, and dealt by word in buckets:
    small rows of a word's name, its place and the word before it, and the set's
    sketch once a bucket.  Length filter and bounds on the overlap, which must
    reach t/(1+t) * (na + nb), hold in the task that meets a bucket (``meets``);
    that of the short sketches follows there, before pairs are gathered."""
    prefixes = (1.0 - threshold) * int(counts.sum())
    dealt = groups.select("gid", _hashes(by).alias("words")).mapInArrow(
        meets.deal(threshold, np.minimum(counts, (1 << 31) - 1).astype(np.int32), max(LEAST, int(prefixes / ROWS)), probes),
        "bucket int, sets binary, rows binary, sketches binary")
    met = dealt.groupBy("bucket").applyInArrow(meets.meetings(threshold), "ka long, kb long, na int, nb int, both int, " + ", ".join(
        f"x{k} long" for k in range(meets.SHORT)))
    needed = (F.col("na") + F.col("nb")) * F.lit(threshold / (1.0 + threshold)) - F.lit(EPS)
    differ = sum((F.bit_count(f"x{k}") for k in range(meets.SHORT)), F.lit(0))
    return met.where(F.col("both") - differ >= 2 * needed).groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("met")).select("ka", "kb")


def _overlaps(groups: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``(ka, kb, na, nb, inter)`` of pairs (written, and dropped here).

    Sets of one family meet in one task, so that a set's words go there once and
    not once a pair: a pair goes to the least number around its first set.  Where
    very many are near one set, they are cut into blocks, and each pair of blocks is
    a place of its own."""
    ends = pairs.select("ka", "kb").unionByName(pairs.select(F.col("kb").alias("ka"), F.col("ka").alias("kb")))
    nodes = materialize(ends.groupBy("ka").agg(F.least(F.min("kb"), "ka").alias("label"), F.count(F.lit(1)).alias("near")), "near-nodes")
    hubs = nodes.select(F.col("ka").alias("label"), F.col("near").alias("hub"))
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("near", "hub", F.lit(BLOCK)) / F.lit(BLOCK)))).cast("bigint")
    i, j = (F.pmod(F.xxhash64(k), F.col("blocks")) for k in ("ka", "kb"))
    buckets = max(LEAST, words // WORDS, pairs.count() // ROWS)
    keyed = pairs.join(nodes.join(hubs, "label").select("ka", "label", blocks.alias("blocks")), "ka").select(
        F.pmod(F.xxhash64("label", "blocks", F.least(i, j), F.greatest(i, j)), F.lit(buckets)).cast("int").alias("bucket"), "ka", "kb")
    keyed = materialize(keyed, "near-dealt")
    wanted = _slots(nodes.select("ka"))
    drop_materialized(pairs, nodes)
    members = keyed.select("bucket", F.explode(F.array("ka", "kb")).alias("gid")).distinct()
    texts = groups.select("gid", "text").mapInArrow(meets.kept(wanted), "gid long, text string").join(members, "gid")
    rows = keyed.select("bucket", "ka", "kb", F.lit(None).cast("string").alias("text")).unionByName(
        texts.select("bucket", F.col("gid").alias("ka"), F.lit(None).cast("bigint").alias("kb"), "text"))
    out = materialize(rows.groupBy("bucket").applyInArrow(meets.overlaps, "ka long, kb long, na long, nb long, inter long"), "near-overlaps")
    drop_materialized(keyed)
    return out


def near_duplicates(df: DataFrame, threshold: float = 0.75, by: list[str] | None = None,
                    groups: DataFrame | None = None) -> DataFrame:
    """Pairs of distinct word sets with Jaccard >= ``threshold``.

    Columns ``(…by, id_a, id_b, jaccard, copies_a, copies_b)``; ``id_a`` is the
    newer representative.  Each such row stands for ``copies_a * copies_b``
    row pairs; pairs of identical sets are in ``duplicate_copies``.

    The copy-group table feeds several steps, so it is materialised once
    (``util.materialize``) and dropped when the pairs are written; pass ``groups``
    (from ``near_duplicate_groups``) to share it with ``pair_count``.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    by = list(by or [])
    own = groups is None
    groups = near_duplicate_groups(df, by) if own else groups
    out = _near_pairs(groups, _class_counts(groups, by), threshold, by)
    if own:
        drop_materialized(groups)
    return out


def _near_pairs(groups: DataFrame, counts: np.ndarray, threshold: float, by: list[str], newer: DataFrame | None = None) -> DataFrame:
    """Verified pairs, written; with ``newer`` (numbers of the newest sets) those
    whose newer set is one of them."""
    cand = materialize(_candidates(groups, counts, threshold, by, None if newer is None else _slots(newer)), "near-pairs")
    inter = _overlaps(groups, cand, int(counts.sum()))
    ver = inter.select("ka", "kb", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("jaccard"))
    ver = ver.filter(F.col("jaccard") >= F.lit(threshold))
    for x in ("a", "b"):
        g = groups.select(F.col("gid").alias(f"k{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("rep_id", "rep_created_at", "copies")],
                          *[F.col(c).alias(c if x == "a" else f"_b_{c}") for c in by])
        ver = ver.join(g.hint("merge"), f"k{x}")
    for c in by:        # hashes of words may be equal in two scopes; null is no scope
        ver = ver.where(F.col(c) == F.col(f"_b_{c}"))
    a_newer = F.struct((-F.unix_micros("rep_created_at_a")), F.col("rep_id_a")) < \
        F.struct((-F.unix_micros("rep_created_at_b")), F.col("rep_id_b"))
    if newer is not None:
        ver = ver.withColumn("gid", F.when(a_newer, F.col("ka")).otherwise(F.col("kb"))).join(newer, "gid", "left_semi")
    out = materialize(ver.select(
        *by,
        F.when(a_newer, F.col("rep_id_a")).otherwise(F.col("rep_id_b")).alias("id_a"),
        F.when(a_newer, F.col("rep_id_b")).otherwise(F.col("rep_id_a")).alias("id_b"),
        "jaccard",
        F.when(a_newer, F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies_a"),
        F.when(a_newer, F.col("copies_b")).otherwise(F.col("copies_a")).alias("copies_b"),
    ), "near-verified")
    drop_materialized(inter)
    return out


def near_duplicate_groups(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The materialised copy-group table shared by D4 operators: ``(…by, gid,
    rep_id, rep_created_at, copies, text)``; sets are numbered (``gid``), and their
    words one sorted text, which takes less room in the shuffle than a list."""
    by = list(by or [])
    sets = df.select(*by, "id", "created_at", F.array_join(F.sort_array(word_set("content")), " ").alias("text"))
    groups = sets.withColumn("set_key", F.sha2("text", 256)).groupBy(*by, "set_key").agg(
        F.min(F.struct(_newest_key().alias("k"), F.col("created_at"))).alias("_rep"),
        F.count(F.lit(1)).alias("copies"), F.any_value("text").alias("text")).where("text <> ''")
    return materialize(groups.select(*by, F.col("_rep.k.id").alias("rep_id"), F.col("_rep.created_at").alias("rep_created_at"), "copies", "text",
                                     F.monotonically_increasing_id().alias("gid")), "near-groups")


def pair_count(df: DataFrame, threshold: float = 0.75, by: list[str] | None = None,
               pairs: DataFrame | None = None) -> DataFrame:
    """Exact number of unordered row pairs with Jaccard >= t, per scope:
    ``sum(copies_a * copies_b)`` over near pairs + ``sum(C(copies, 2))`` over
    identical sets.  ``(…by, pairs)``; computed from aggregates only."""
    by = list(by or [])
    groups = near_duplicate_groups(df, by)
    pairs = pairs if pairs is not None else near_duplicates(df, threshold, by, groups=groups)
    near = pairs.select(*by, (F.col("copies_a") * F.col("copies_b")).cast("bigint").alias("p"))
    same = groups.select(*by, (F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("p"))
    scopes = df.select(*by).distinct().select(*by, F.lit(0).cast("bigint").alias("p")) if by else \
        df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("p"))
    out = materialize(near.unionByName(same).unionByName(scopes).groupBy(*by).agg(F.sum("p").alias("pairs")), "pair-count")
    drop_materialized(groups)
    return out


def newest_pairs(df: DataFrame, threshold: float = 0.75, n: int = 3, first: int = 1000, growth: int = 8) -> DataFrame:
    """A8 without the table of all pairs: the first ``n`` pairs, newest
    first, as ``example_pairs`` gives them.

    Pairs are ordered by their newer set, so the pairs of the newest sets come
    before all others.  The ``first`` newest sets are paired with all sets; while
    that gives fewer than ``n`` pairs, ``growth`` times as many are tried.
    """
    groups = near_duplicate_groups(df)
    counts = _class_counts(groups, [])
    total, size = groups.count(), first
    while True:
        newest = materialize(groups.orderBy(F.col("rep_created_at").desc(), "rep_id").limit(size).select("gid"), "newest")
        pairs = _near_pairs(groups, counts, threshold, [], newest)
        drop_materialized(newest)
        if size >= total or pairs.limit(n).count() == n:
            break
        drop_materialized(pairs)
        size *= growth
    times = groups.select(F.col("rep_id").alias("id_a"), F.col("rep_created_at").alias("ca"))
    found = pairs.join(times, "id_a").orderBy(F.col("ca").desc(), "id_a", "id_b").limit(n)
    w = Window.orderBy(F.col("ca").desc(), "id_a", "id_b")      # n rows
    out = materialize(found.withColumn("rank", F.row_number().over(w)).drop("ca"), "newest-pairs")
    drop_materialized(groups, pairs)
    return out


def example_pairs(df: DataFrame, pairs: DataFrame, n: int = 3, by: list[str] | None = None) -> DataFrame:
    """A8 (second half): the first ``n`` pairs per scope, newest ``a`` first."""
    by = list(by or [])
    ts = df.select(*by, F.col("id").alias("id_a"), F.col("created_at").alias("ca"))
    w = Window.partitionBy(*by).orderBy(F.col("ca").desc(), F.col("id_a"), F.col("id_b"))
    return (pairs.join(ts, by + ["id_a"]).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n).drop("ca"))

"""Operator 13, phrase collocation mining by SON partitioning.

Documents are dealt to ``SHARDS`` shards.  A phrase that occurs ``least`` times
in its language occurs in some shard at least as often as the shard's share of
the language's words asks for (rounded up).  So:

1. every shard is mined completely at its lowered support, all shards in one
   distributed aggregation keyed by (phrase, shard), words first, then two,
   three and four words.  A phrase is counted only if both its parts without
   the last and without the first word were frequent in that shard.  Which
   ones were is handed on as ``FILTER_BITS`` bits, the hash classes of
   the frequent phrases: a fixed size, never a false "no"; a false "yes" costs a
   counter and no more;
2. the locally frequent phrases of all shards together are the candidates,
   again as hash classes;
3. one more pass counts every candidate over all documents, keyed by language
   and the phrase's own text, so the counts are exact whatever hashes collide.

Scores are decimals of 38 digits and divide as integers.  The ranking keeps the
first ``top`` of ever larger groups, so no task sorts a whole language.

Tasks handle blocks of texts; a longer text is cut between words, and a block
sees the words behind it that its phrases need.  Counts are summed in a block
before they are shuffled: a line repeated in a third of the rows is
one row a block.

Defined cases: null and empty texts have no words; null languages are
``und``; rows count once each, also repeated rows and null ids; ties in score
fall to the more frequent, then to the smaller phrase in bytes; further columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 8
LONGEST = 4
FILTER_BITS = 26
#: Bytes of text handled together, and of the stretches whose letters are hashed together.
BLOCK = 1 << 20
STRETCH = 1 << 18

_U = np.uint64
_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)       # odd: invertible modulo 2^64
_tables: dict = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(base: int):
    if base not in _tables:
        def table(b):
            t = np.full(STRETCH + 1, b, _U)
            t[0] = 1
            return np.multiply.accumulate(t)
        _tables[base] = table(_U(base)), table(_U(pow(base, -1, 1 << 64)))
    return _tables[base]


def _word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit name of each word from sums of its bytes times powers of
    ``base``, made stretch by stretch."""
    up, down = _powers(base)
    low, high, inverse = (np.zeros(len(starts), _U) for _ in range(3))
    carry, scale, unscale = _U(0), 1, 1
    with np.errstate(over="ignore"):
        for s in range(0, len(data), STRETCH):
            part = data[s: s + STRETCH]
            sums = np.zeros(len(part) + 1, _U)
            np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)], out=sums[1:])
            sums = sums * _U(scale) + carry
            a, b = np.searchsorted(starts, (s, s + len(part)))
            low[a:b] = sums[starts[a:b] - s]
            inverse[a:b] = down[starts[a:b] - s] * _U(unscale)
            a, b = np.searchsorted(ends, (s + 1, s + len(part) + 1))
            high[a:b] = sums[ends[a:b] - s]
            carry = sums[-1]
            scale = scale * pow(base, STRETCH, 1 << 64) % (1 << 64)
            unscale = unscale * pow(base, -STRETCH, 1 << 64) % (1 << 64)
        return _mix((high - low) * inverse + (ends - starts).astype(_U))


class Block:
    """The words of some bytes of text: where they are, whether the next ones
    are in the same piece, and names that include the language."""

    def __init__(self, data, row_starts, fresh, rows, names, groups):
        self.data = _LOWER[data]
        kind = _KIND[data]
        word = kind == 0
        first = np.zeros(len(data) + 1, bool)
        first[row_starts] = True
        before = np.concatenate(([False], word[:-1]))
        behind = np.concatenate((word[1:], [False]))
        self.starts = np.flatnonzero(word & (~before | first[:-1]))
        self.ends = np.flatnonzero(word & (~behind | first[1:])) + 1
        row = np.searchsorted(row_starts, self.starts, "right") - 1
        breaks = np.flatnonzero(kind == _BREAK)
        piece = np.searchsorted(breaks, self.starts)
        self.same = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        self.row = rows[row] if len(row) else row
        self.fresh = self.starts < fresh
        self.language, self.group = names[self.row], groups[self.row]
        self.joined = self.places = None

    def words(self, base: int = _BASES[0]) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix(_word_names(self.data, self.starts, self.ends, base) + self.language)

    def phrases(self, words: np.ndarray, n: int):
        """Names of the ``n`` words from each start, and which starts have them in one piece."""
        m = max(len(words) - n + 1, 0)
        if not m:
            return np.empty(0, _U), np.empty(0, bool)
        name, whole = words[:m], np.ones(m, bool)
        with np.errstate(over="ignore"):
            for k in range(1, n):
                name = _mix(name * _U(0xA0761D6478BD642F) + words[k: k + m])
                whole &= self.same[k - 1: k - 1 + m]
        return name, whole

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of ``n`` words from the words ``at``, joined by one space."""
        size = self.ends - self.starts
        if self.joined is None:
            self.places = np.cumsum(size + 1) - size - 1
            self.joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
            self.joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = self.data[_KIND[self.data] == 0]
        start = self.places[at]
        length = self.places[at + n - 1] + size[at + n - 1] - start
        ends = np.concatenate(([0], np.cumsum(length)))
        flat = self.joined[np.arange(ends[-1]) + np.repeat(start - ends[:-1], length)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())


def _cuts(kind: np.ndarray, block: int):
    """Ends of stretches of a long text, each beside a byte of no word, and how
    far the words reach that phrases from before the end need."""
    at = 0
    while len(kind) - at > block:
        end = at + block
        while end < len(kind) and kind[end] == 0:
            other = np.flatnonzero(kind[end: end + block])
            end = end + int(other[0]) if len(other) else min(end + block, len(kind))
        if end >= len(kind):
            break
        size = 1 << 12
        while True:
            ahead = kind[end: end + size]
            starts = np.flatnonzero((ahead == 0) & np.concatenate(([True], ahead[:-1] != 0)))
            if len(starts) >= LONGEST or end + size >= len(kind):
                break
            size *= 4
        yield at, end, end + (int(starts[LONGEST - 1]) if len(starts) >= LONGEST else len(ahead))
        at = end
    yield at, len(kind), len(kind)


def blocks(batch: pa.RecordBatch, block: int):
    """All texts of a batch of (text, lang, shard) as ``Block`` objects, and the languages by row."""
    text = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
    langs = batch.column("lang").to_pylist()
    code = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in set(langs)}
    names = np.array([code[lang] for lang in langs], _U)
    shard = batch.column("shard").to_numpy(zero_copy_only=False).astype(_U)
    # The shard in the highest bits, which choose the hash class.
    groups = (names >> _U(3)) | (shard << _U(61))
    i = 0
    while i < len(langs):
        if offsets[i + 1] - offsets[i] > block:
            row = data[offsets[i]: offsets[i + 1]]
            for a, fresh, b in _cuts(_KIND[row], block):
                yield Block(row[a:b], np.zeros(1, np.int64), fresh - a, np.array([i]), names, groups), langs
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
        j = min(j, len(langs))
        here = offsets[i: j + 1] - offsets[i]
        rows = np.flatnonzero(here[1:] > here[:-1])
        if len(rows):
            yield Block(data[offsets[i]: offsets[j]], here[rows], here[-1], rows + i, names, groups), langs
        i = j


def _held(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names >> _U(64 - FILTER_BITS)
    return (bits[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1


def _tally(keys: np.ndarray):
    """Order of ``keys``, and where each distinct one begins in it."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return order, first, np.diff(np.concatenate((first, [len(keys)])))


def _local(n: int, shorter, block: int):
    """(name, shard and language, count) of the phrases of ``n`` words."""
    def run(batches):
        bits = shorter.value if shorter is not None else None
        for batch in batches:
            for b, _ in blocks(batch, block):
                words = b.words()
                name, whole = b.phrases(words, n)
                whole &= b.fresh[: len(whole)]
                if bits is not None and len(name):
                    part = b.phrases(words, n - 1)[0]
                    held = _held(bits, part ^ b.group[: len(part)])
                    whole &= held[: len(name)] & held[1: len(name) + 1]
                at = np.flatnonzero(whole)
                name, group = name[at], b.group[at]
                order, first, count = _tally(_mix(name ^ group))
                pick = order[first]
                yield pa.RecordBatch.from_arrays([pa.array(name[pick].view(np.int64)), pa.array(group[pick].view(np.int64)),
                                                  pa.array(count.astype(np.int64))], names=["h", "g", "c"])
    return run


def _rows(langs: pa.Array, k: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(langs), k, np.int32)), phrases, pa.array(counts.astype(np.int64))],
                                      names=["lang", "k", "phrase", "c"])


def _counted(candidates, block: int):
    """(lang, words, phrase, count) of all candidates, and of all words under
    the empty phrase of 0 words."""
    def run(batches):
        bits = candidates.value
        for batch in batches:
            for b, langs in blocks(batch, block):
                words, other = b.words(), b.words(_BASES[1])
                spoken = pa.array(langs, pa.string())
                row, times = np.unique(b.row[b.fresh], return_counts=True)
                yield _rows(spoken.take(pa.array(row)), 0, pa.array([""] * len(row), pa.string()), times)
                for n in range(1, LONGEST + 1):
                    name, whole = b.phrases(words, n)
                    whole &= b.fresh[: len(whole)]
                    whole &= _held(bits, name)
                    at = np.flatnonzero(whole)
                    if not len(at):
                        continue
                    name, check = name[at], b.phrases(other, n)[0][at]
                    order, first, count = _tally(name)
                    check = check[order]
                    # Where two phrases share a name, the second name tells; their places are given one by one.
                    shared = np.maximum.reduceat(check, first) != np.minimum.reduceat(check, first)
                    alone = np.repeat(shared, count)
                    for some, c in ((at[order[first[~shared]]], count[~shared]), (at[order[alone]], np.ones(int(alone.sum()), np.int64))):
                        if len(some):
                            yield _rows(spoken.take(pa.array(b.row[some])), n, b.texts(some, n), c)
    return run


def _classes(spark, frames: list[DataFrame], by_shard: bool):
    """Hash classes of (h, g) rows as a broadcast array of 2^FILTER_BITS bits."""
    name = F.col("h").bitwiseXOR(F.col("g")) if by_shard else F.col("h")
    bits = np.zeros(1 << (FILTER_BITS - 6), _U)
    for frame in frames:
        at = frame.select(F.shiftrightunsigned(name, 64 - FILTER_BITS).alias("at"))
        words = (at.groupBy(F.shiftright("at", 6).cast("int").alias("word"))
                 .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63L as int)))").alias("bits")).toArrow())
        np.bitwise_or.at(bits, words["word"].to_numpy(), words["bits"].to_numpy().view(_U))
    return spark.sparkContext.broadcast(bits)


def frequent_phrases(docs: DataFrame, least: int = 30, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """``docs`` (lang, text, shard) to a written table (lang, k, phrase, c) of all
    phrases of up to ``LONGEST`` words that occur ``least`` times in their
    language; the row of ``k`` 0 has the number of its words."""
    spark, found, shorter, need = docs.sparkSession, [], None, None
    for n in range(1, LONGEST + 1):
        rows = docs.mapInArrow(_local(n, shorter, block), "h long, g long, c long")
        counts = rows.groupBy("h", "g").agg(F.sum("c").alias("c"))
        if n == 1:
            counts = words = staged(counts, "op13-words")
            sizes = words.groupBy("g").agg(F.sum("c").alias("n_g")).withColumn("lang_name", F.expr("g & 2305843009213693951"))
            whole = sizes.groupBy("lang_name").agg(F.sum("n_g").alias("n"))
            need = staged(sizes.join(whole, "lang_name").select("g", F.expr(f"({least} * n_g + n - 1) div n").alias("need")), "op13-need")
        kept = staged(counts.join(need, "g").where("c >= need").select("h", "g"), "op13-frequent")
        if n == 1:
            dropped(words)
        if shorter is not None:
            shorter.destroy()
        found.append(kept)
        shorter = _classes(spark, [kept], True) if n < LONGEST else None
    candidates = _classes(spark, found, False)
    dropped(need, *found)
    rows = docs.mapInArrow(_counted(candidates, block), "lang string, k int, phrase string, c long")
    phrases = rows.groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c")).where(f"c >= {least} or k = 0")
    phrases = staged(phrases, "op13-phrases")
    candidates.destroy()
    return phrases


def first_of(rows: DataFrame, by: str, order: list, top: int, widths=(4096, 64, 1)) -> DataFrame:
    """The first ``top`` rows of each ``by`` with their ``rank``, kept in ever larger groups."""
    for width in widths:
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(width)))
        w = Window.partitionBy(by, "_part").orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("_part")
    return rows.withColumn("rank", F.col("rank").cast("long"))


def score_phrases(phrases: DataFrame, cover: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more
    that no longer one covers in ``cover`` of 100 places."""
    words = F.split("phrase", " ")
    many = phrases.where("k >= 2").withColumn("w", words)
    counts = phrases.where("k >= 1").select("lang", "phrase", "c")

    def joined(start, size):
        return F.array_join(F.slice("w", start, size), " ")
    cut = many.select("lang", "phrase", "w", F.col("c").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.select("lang", "phrase", "a", "at", joined(F.lit(1), F.col("at")).alias("left"),
                     joined(F.col("at") + 1, F.size("w") - F.col("at")).alias("right"))
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r")), ["lang", "right"])
    big = "cast({} as decimal(19,0))"
    cut = cut.withColumn("score", F.expr(f"(cast(2000000 as decimal(7,0)) * {big.format('a')}) div ({big.format('l')} + {big.format('r')})"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    places = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " ")))), lambda x: x.isNotNull())
    within = many.where("k >= 3").select("lang", F.explode(F.array_distinct(places)).alias("phrase"), "c")
    within = within.groupBy("lang", "phrase").agg(F.max("c").alias("longer"))
    best = best.join(within, ["lang", "phrase"], "left").where(F.expr(
        f"longer is null or cast(100 as decimal(3,0)) * {big.format('longer')} < cast({cover} as decimal(3,0)) * {big.format('a')}"))
    sizes = phrases.where("k = 0").select("lang", F.col("c").alias("n"))
    return best.drop("longer").join(sizes, "lang")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, shards: int = SHARDS, block: int = BLOCK,
                 id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    if not 1 <= shards <= 8:
        raise ValueError("1 to 8 shards")
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"),
                       F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"))
    scored = score_phrases(frequent_phrases(docs, least, shards, block), cover)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    return first_of(scored, "lang", order, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Operator 6, near-duplicates by improved consistent weighted sampling.

A text is the multiset of its five-word shingles (words are runs of letters,
digits and non-ASCII bytes, ASCII letters in lower case; a shorter text is one
shingle).  A shingle weighs its count in the text times

    1 + ln((1 + N) / (1 + df)) / (4 ln(2 + N))

for N documents, between 1 and 1.25: rare shingles count more, but texts that
are near by plain Jaccard similarity stay near when many copies have made
their common shingles frequent.  df is the number of (document, shingle) pairs in the shingle's
hash class, of 2^20 classes (a table of fixed size, counted over all
documents).  Two texts are near if their weighted Jaccard similarity is at
least ``least`` (0.8).

* Texts of equal word sequence are collapsed first; from here on there is one
  row for each different text.
* ``SAMPLES`` consistent weighted samples of each text (Ioffe's r, c, beta for
  sample k and shingle are drawn from a table of 2^16 triples by their hash),
  and ``BANDS`` band keys of ``ROWS`` samples each.
* The members of a bucket (equal band key) are paired with two of them, other
  ones in each band; buckets of at most ``SMALL`` members give all pairs.  So a
  large group costs rows in proportion to its members.  Pairs that agree in
  fewer than ``AGREE`` samples are dropped (a pair at 0.8 has 38 on average).
* Pairs are verified by exact weighted Jaccard similarity: first the best of
  each member, then all others that still join different components.
* A larger bucket that is then of more than one component is a crowd: texts of
  one template below 0.8, say, with near pairs among them that neither of the
  two stood for.  All shingles of all its members are indexed.  Texts of
  different components that share a shingle held by at most ``FEW`` of them are
  all paired, and every text with two holders of each of its other shingles:
  the lightest (if two texts share but the template and are near, both are near
  the lightest that has it) and the one of least hash.  These pairs are verified
  likewise.
* In what is then still a crowd, every member meets every member of another
  component, without a further filter: a bucket is cut into blocks of about
  ``BLOCK`` members or ``BLOCK_BYTES`` of text, each pair of blocks is one
  group, and the weights that two texts share are summed for all pairs of a
  group by matrix products.  Blocks of one component are not paired with each
  other.  So no two near texts of one bucket end in different classes.
* Classes are the connected components of the verified links.

Defined cases: null texts and texts without a word are classes of their own; a
row with a null id is returned with a null class; rows that share an id are one
document; the smallest id of a class is its class id; further columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .batches import Out, byte_texts
from .common import dropped, id_text, staged
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, CLASS_BITS = 5, 20
SAMPLES, BANDS, ROWS, AGREE, SMALL, FEW = 48, 24, 4, 26, 6, 16
BLOCK, BLOCK_BYTES = 512, 1 << 21
_U = np.uint64
_bytes = np.arange(256)
_LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(_U) + _U(1)
_WORD = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)


def word_names(text: np.ndarray) -> np.ndarray:
    inside = _WORD[text]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, _U)
    sums = np.zeros(len(text) + 1, _U)
    np.cumsum(_LOWER[text] * W._power("up", W._BASE, len(text)), out=sums[1:])
    return W.mix((sums[end] - sums[start]) * W._power("down", W._INVERSE, len(text))[start] + (end - start).astype(_U))


def shingles(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names, sorted, and their counts."""
    if not len(names):
        return names, np.empty(0, np.int64)
    return np.unique(W.gram_names(names, min(SHINGLE, len(names))), return_counts=True)


def _class(names: np.ndarray) -> np.ndarray:
    return (names >> _U(64 - CLASS_BITS)).astype(np.int64)


def _class_counts(batches):
    total, waiting, n = np.zeros(1 << CLASS_BITS, np.int64), [], 0

    def add():
        nonlocal waiting, n
        if waiting:
            total[:] += np.bincount(np.concatenate(waiting), minlength=len(total))
        waiting, n = [], 0

    for batch in batches:
        for text in byte_texts(batch.column("text")):
            names, _ = shingles(word_names(text))
            waiting.append(_class(names))
            n += len(names)
            if n > 1 << 20:
                add()
    add()
    slots = np.flatnonzero(total)
    for at in range(0, len(slots), 100_000):
        part = slots[at: at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "df"])


def weights_table(docs: DataFrame) -> np.ndarray:
    """Weight of each hash class; 2^20 numbers whatever the input."""
    n = docs.where("text is not null").count()
    sums = (docs.where("text is not null").select("text").mapInArrow(_class_counts, "slot long, df long")
            .groupBy("slot").agg(F.sum("df").alias("df")).toArrow())
    df = np.zeros(1 << CLASS_BITS)
    df[sums.column("slot").to_numpy()] = sums.column("df").to_numpy()
    return (1 + np.maximum(np.log((1 + n) / (1 + df)), 0) / (4 * np.log(2 + n))).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling."""

    def __init__(self, seed: int = 11):
        chance = np.random.default_rng(seed)
        size = 1 << 16
        self.r = chance.gamma(2, 1, size)
        self.beta = chance.random(size)
        self.log_c = np.log(chance.gamma(2, 1, size))
        self.odd = chance.integers(1 << 63, size=SAMPLES, dtype=_U) * _U(2) + _U(1)
        self.bands = np.array([chance.choice(SAMPLES, ROWS, replace=False) for _ in range(BANDS)])

    def sample(self, names: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit name (of shingle and level t) for each sample."""
        best, found = np.full(SAMPLES, np.inf), np.zeros(SAMPLES, _U)
        rows = np.arange(SAMPLES)
        for at in range(0, len(names), 2048):
            part, log_w = names[at: at + 2048], np.log(weights[at: at + 2048])
            pick = ((part[None, :] * self.odd[:, None]) >> _U(48)).astype(np.int64)
            r, beta = self.r[pick], self.beta[pick]
            t = np.floor(log_w / r + beta)
            a = self.log_c[pick] - r * (t - beta + 1)
            i = a.argmin(axis=1)
            least = a[rows, i]
            better = least < best
            best[better] = least[better]
            found[better] = W.join_names(part[i], t[rows, i].astype(np.int64).view(_U))[better]
        return found

    def keys(self, samples: np.ndarray) -> np.ndarray:
        key = np.arange(BANDS, dtype=_U)
        for j in range(ROWS):
            key = W.join_names(key, samples[self.bands[:, j]])
        return key


def _signed(table):
    def run(batches):
        sampler, weights = Sampler(), table.value
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for text in byte_texts(batch.column("text")):
                words = word_names(text)
                names, counts = shingles(words)
                if not len(names):
                    rows.append((None, None, None, None))
                    continue
                samples = sampler.sample(names, counts * weights[_class(names)])
                place = np.arange(len(words), dtype=_U)
                rows.append((int(W.mix(words + W.mix(place)).sum().view(np.int64)),
                             int(W.mix(words ^ W.mix(place + _U(1 << 40))).sum().view(np.int64)),
                             sampler.keys(samples).view(np.int64), (samples >> _U(32)).astype(np.uint32).view(np.int32)))
            k1, k2, keys, samples = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(samples, pa.list_(pa.int32()))], names=["doc_id", "k1", "k2", "keys", "samples"])
    return run


def _agreed(pairs: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
    """The pairs (a, b) with enough equal samples, and their number."""
    of = texts.select(F.col("doc_id").alias("a"), F.col("samples").alias("sa"))
    with_a = staged(pairs.join(of, "a"), f"op6-{tag}-a")
    equal = F.expr("aggregate(zip_with(sa, sb, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)")
    agreed = staged(with_a.join(of.withColumnRenamed("a", "b").withColumnRenamed("sa", "sb"), "b")
                    .select("a", "b", equal.alias("agree")).where(F.col("agree") >= AGREE), f"op6-{tag}-agreed")
    dropped(with_a)
    return agreed


def _candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) of different texts with their number of equal samples,
    and the members (key, doc_id) of the buckets of which not all are paired."""
    rows = texts.select("doc_id", F.posexplode("keys").alias("band", "key"))
    order = F.xxhash64("doc_id", "band")
    # Two members of each bucket, chosen by hashes that differ from band to band.
    buckets = (rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("o"), "doc_id"))["doc_id"].alias("c0"),
                                               F.max(F.struct(order.alias("o"), "doc_id"))["doc_id"].alias("c1")).where("n > 1"))
    buckets = staged(buckets, "op6-buckets")
    members = rows.join(buckets, ["band", "key"])
    stars = members.select("doc_id", F.explode(F.array("c0", "c1")).alias("center"))
    small = (members.where(F.col("n") <= SMALL).groupBy("band", "key").agg(F.collect_list("doc_id").alias("all"))
             .select(F.explode("all").alias("doc_id"), "all").select("doc_id", F.explode("all").alias("center")))
    pairs = (stars.unionByName(small).where("doc_id <> center")
             .select(F.least("doc_id", "center").alias("a"), F.greatest("doc_id", "center").alias("b")).distinct())
    pairs = staged(pairs, "op6-pairs")
    large = staged(members.where(F.col("n") > SMALL).select("key", "doc_id"), "op6-large")      # the key tells the band too
    agreed = _agreed(pairs, texts, "pairs")
    dropped(pairs, buckets)
    return agreed, large


def _crowds(large: DataFrame, comps: DataFrame, tag: str) -> DataFrame:
    """(key, doc_id, comp) of the members of large buckets that are not of one component."""
    of = staged(large.join(comps.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left")
                .select("key", "doc_id", F.coalesce("comp", "doc_id").alias("comp")), f"op6-{tag}-comps")
    several = of.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    crowds = staged(of.join(several, "key", "left_semi"), f"op6-{tag}")
    dropped(of)
    return crowds


def _indexed(table):
    def run(batches):
        for batch in batches:
            ids, comps = batch.column("doc_id").to_numpy(), batch.column("comp").to_numpy()
            for i, text in enumerate(byte_texts(batch.column("text"))):
                names, counts = shingles(word_names(text))
                weight = float((counts * table.value[_class(names)]).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(names), ids[i])), pa.array(np.full(len(names), comps[i])),
                     pa.array(np.full(len(names), weight)), pa.array(names.view(np.int64))], names=["doc_id", "comp", "weight", "shingle"])
    return run


def _sharing(crowds: DataFrame, bodies: DataFrame, table) -> DataFrame:
    """Pairs (a < b) of different components that share a shingle."""
    index = staged(bodies.join(crowds.select("doc_id", "comp").distinct(), "doc_id").mapInArrow(_indexed(table), "doc_id long, comp long, weight double, shingle long"), "op6-index")
    one = F.struct("doc_id", "comp")
    shared = staged(index.groupBy("shingle").agg(
        F.count("*").alias("n"), F.min(F.struct("weight", "doc_id", "comp")).alias("c0"),
        F.min(F.struct(F.xxhash64("doc_id").alias("o"), "doc_id", "comp")).alias("c1"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where("low <> high").select("shingle", "n", *(F.struct(f"{c}.doc_id", f"{c}.comp").alias(c) for c in ("c0", "c1"))), "op6-shared")
    members = index.select("shingle", one.alias("x")).join(shared, "shingle")
    stars = members.where(F.col("n") > FEW).select("x", F.explode(F.array("c0", "c1")).alias("y"))
    few = (members.where(F.col("n") <= FEW).groupBy("shingle").agg(F.collect_list("x").alias("all"))
           .select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.doc_id < y.doc_id"))
    pairs = staged(stars.unionByName(few).where("x.comp <> y.comp").select(
        F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), "op6-sharing")
    dropped(index, shared)
    return pairs


def _block_pairs(table, least: float):
    """The near pairs of different components between two blocks, or in one."""
    def run(group: pa.Table) -> pa.Table:
        ids, comps = (group.column(c).combine_chunks().to_numpy() for c in ("doc_id", "comp"))
        sides = [group.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(bool) for c in ("in_x", "in_y")]
        texts = [t for chunk in group.column("text").chunks for t in byte_texts(chunk)]
        bags = [shingles(word_names(t)) for t in texts]
        # The second and further copies of a shingle in a text are shingles of their own: shared weights are then plain sums.
        names = [np.repeat(n, c) for n, c in bags]
        level = [np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c) for r, (_, c) in zip(names, bags, strict=True)]
        flat = np.concatenate([n + W.mix(j.astype(_U)) for n, j in zip(names, level, strict=True)])
        weight = table.value[_class(np.concatenate(names))]
        row = np.repeat(np.arange(len(texts)), [len(n) for n in names])
        whole = np.bincount(row, weight, len(texts))
        _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
        both = held[column] > 1
        row, weight = row[both], weight[both]
        _, column = np.unique(column[both], return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, weight, column = row[order], weight[order], column[order]
        x, y = (np.flatnonzero(side) for side in sides)
        shared = np.zeros((len(x), len(y)))
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            part = slice(*np.searchsorted(column, (at, at + 4096)))
            here = np.zeros((len(texts), 4096), np.float32)
            here[row[part], column[part] - at] = np.sqrt(weight[part])
            shared += here[x] @ here[y].T
        near = shared >= (least - 1e-3) * (whole[x][:, None] + whole[y][None, :] - shared)
        i, j = (v[k] for v, k in zip((x, y), np.nonzero(near & (comps[x][:, None] != comps[y][None, :])), strict=True))
        found = sorted({(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)})
        links = [(*sorted((int(ids[a]), int(ids[b]))), v) for a, b in found if (v := weighted_jaccard(texts[a], texts[b], table.value)) >= least]
        return pa.table({"a": pa.array([k[0] for k in links], pa.int64()), "b": pa.array([k[1] for k in links], pa.int64()),
                         "similarity": pa.array([k[2] for k in links], pa.float64())})
    return run


def _every_pair(crowds: DataFrame, bodies: DataFrame, table, least: float) -> DataFrame:
    """All near pairs (a < b) of different components in the buckets ``crowds``
    (key, doc_id, comp), by pairs of blocks."""
    size = F.greatest(F.lit(1 / BLOCK), F.octet_length("text") / F.lit(BLOCK_BYTES))
    sized = staged(crowds.join(bodies.select("doc_id", size.alias("size")), "doc_id"), "op6-sized")
    # A component of half a block and more has blocks of its own; the others of a bucket share theirs.
    own = sized.groupBy("key", "comp").agg((F.sum("size") < 0.5).alias("mixed"))
    placed = sized.join(own, ["key", "comp"]).withColumn("part", F.when(F.col("mixed"), 0).otherwise(F.col("comp")))
    counts = staged(placed.groupBy("key", "mixed", "part").agg(F.ceil(F.sum("size")).cast("int").alias("blocks")), "op6-parts")
    turn = F.pmod(F.xxhash64("doc_id", F.lit(7)), "blocks").cast("int")
    members = staged(placed.join(counts, ["key", "mixed", "part"])
                     .select("key", F.struct("mixed", "part", turn.alias("turn")).alias("block"), "doc_id", "comp"), "op6-members")
    blocks = members.select("key", "block").distinct()
    pairs = (blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "key")
             .where("x <= y and (x.mixed or y.mixed or x.part <> y.part)"))
    pairs = staged(pairs, "op6-block-pairs")
    sides = pairs.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    rows = (sides.join(members, ["key", "block"]).join(bodies.select("doc_id", "text"), "doc_id")
            .select("key", "x", "y", "doc_id", "comp", "text", (F.col("block") == F.col("x")).alias("in_x"), (F.col("block") == F.col("y")).alias("in_y")))
    links = rows.groupBy("key", "x", "y").applyInArrow(_block_pairs(table, least), "a long, b long, similarity double")
    links = staged(links.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "op6-every-pair")
    dropped(sized, counts, members, pairs)
    return links


def weighted_jaccard(one: np.ndarray, other: np.ndarray, weights: np.ndarray) -> float:
    """Of two UTF-8 texts."""
    a, na = shingles(word_names(one))
    b, nb = shingles(word_names(other))
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = float((np.minimum(na[i], nb[j]) * weights[_class(a[i])]).sum())
    return both / (float((na * weights[_class(a)]).sum()) + float((nb * weights[_class(b)]).sum()) - both)


def _verified(table, least: float):
    def run(batches):
        out = Out(a=pa.int64(), b=pa.int64(), similarity=pa.float64())
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for i, (one, other) in enumerate(zip(byte_texts(batch.column("ta")), byte_texts(batch.column("tb")), strict=True)):
                found = weighted_jaccard(one, other, table.value)
                if found >= least:
                    out.add(a[i: i + 1], b[i: i + 1], np.array([found]))
            yield from out.take()
    return run


def _checked(pairs: DataFrame, texts: DataFrame, table, least: float, tag: str) -> DataFrame:
    with_a = staged(pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a"), f"op6-{tag}-texts")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    links = staged(both.mapInArrow(_verified(table, least), "a long, b long, similarity double"), f"op6-{tag}-links")
    dropped(with_a)
    return links


def near_links(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links between different texts (a, b, similarity), their
    components (node, comp), and the copies (doc_id, rep) of each text."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null")
    table = spark.sparkContext.broadcast(weights_table(docs))          # 4 MB at any input size
    signed = staged(docs.mapInArrow(_signed(table), "doc_id long, k1 long, k2 long, keys array<long>, samples array<int>")
                    .where("k1 is not null"), "op6-signed")
    texts = staged(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min_by("keys", "doc_id").alias("keys"),
                                                  F.min_by("samples", "doc_id").alias("samples")), "op6-texts")
    copies = staged(signed.select("doc_id", "k1", "k2").join(texts.select("k1", "k2", F.col("doc_id").alias("rep")), ["k1", "k2"])
                    .select("doc_id", "rep"), "op6-copies")
    dropped(signed)
    pairs, large = _candidates(texts.select("doc_id", "keys", "samples"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(large.select("doc_id")).distinct()
    # By shuffle at every size: the ids grow with the documents, so a broadcast would only hold for small inputs.
    bodies = staged(docs.join(needed.hint("merge"), "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]), "op6-bodies")
    # The best pair of each member (the member is its later text) first.
    turn = Window.partitionBy("b").orderBy(F.desc("agree"), "a")
    first = staged(pairs.withColumn("turn", F.row_number().over(turn)).where("turn = 1").select("a", "b"), "op6-first")
    links = _checked(first, bodies, table, least, "first")
    comps = components(links, "op6-c1")
    rest = pairs.join(first, ["a", "b"], "left_anti").select("a", "b")
    for x in ("a", "b"):
        rest = rest.join(comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")), x, "left")
    rest = staged(rest.where("not (coalesce(ca, a) <=> coalesce(cb, b))").select("a", "b"), "op6-rest")
    more = _checked(rest, bodies, table, least, "rest")
    both = staged(links.unionByName(more), "op6-links")
    dropped(pairs, first, comps, rest, links, more)
    comps = components(both, "op6-c2")
    for tag in ("crowds", "left"):
        crowds = _crowds(large, comps, tag)
        if not crowds.limit(1).count():
            dropped(crowds)
            break
        if tag == "crowds":
            sharing = _sharing(crowds, bodies, table)
            agreed = _agreed(sharing, texts, "crowd")
            further = _checked(agreed.select("a", "b"), bodies, table, least, "crowd")
            dropped(sharing, agreed)
        else:
            further = _every_pair(crowds, bodies, table, least)
        dropped(crowds)
        if further.limit(1).count():
            every = staged(both.unionByName(further), "op6-all-links")
            dropped(both, comps)
            both, comps = every, components(every, f"op6-{tag}-c")
        dropped(further)
    dropped(texts, bodies, large)
    return both, comps, copies


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class),
    n_links (links of its text that the search for classes verified, not all
    its near texts) and kept."""
    docs = id_text(docs, id_col, text_col)
    links, comps, copies = near_links(docs, least)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    reps = staged(comps.withColumnRenamed("node", "rep").join(degree, "rep", "left"), "op6-reps")
    classes = staged(copies.join(reps, "rep", "left").select(
        "doc_id", F.coalesce("comp", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).dropDuplicates(["doc_id"]),
        "op6-classes")
    dropped(links, comps, copies, reps)
    return (docs.select("doc_id").join(classes, "doc_id", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))))

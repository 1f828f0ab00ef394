"""Operator 2, toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed to ``DIMENSIONS`` slots: each word
(ASCII letters in lower case, runs of letters, digits and non-ASCII bytes) and
its first 4 to 7 bytes.  The score is the logistic function of

    w0 + sum(w_i) + sum over pairs i < j of <v_i, v_j>

so a pair of terms can weigh more than both alone.

The machine is fitted on at most ``per_class`` labelled rows of either label
(the first by a hash of their id); that bound keeps the fit small at any corpus
size.  Spark counts the terms by label; the driver gets these counts (two a
slot) and of each text the ids of the slots that the machine keeps.  Scoring
reads whole texts of all rows.

Defined cases: null and empty texts have no term and get the score of w0
alone; null labels are not learned; with no row of one of
the labels the score is the learned share alone (0 if there is no row at all);
repeated labels of an id are learned once each, repeated rows are scored each;
further columns are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .batches import byte_texts
from .common import dropped, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 18
DIMENSIONS = 1 << BITS
PREFIXES = (4, 5, 6, 7)

_bytes = np.arange(256)
_LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint64) + np.uint64(1)
_WORD = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)


def terms(text: np.ndarray) -> np.ndarray:
    """Slots of all terms of one text, with repeats."""
    inside = _WORD[text]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_LOWER[text] * W._power("up", W._BASE, len(text)), out=sums[1:])
    back = W._power("down", W._INVERSE, len(text))[start]
    found = [W.mix((sums[end] - sums[start]) * back)]
    for k in PREFIXES:
        longer = end - start > k
        s = start[longer]
        found.append(W.mix((sums[s + k] - sums[s]) * back[longer] + np.uint64(k)))
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


class Machine:
    """Factorization machine over sets of slots, fitted by AdaGrad.

    Of the slots it keeps those whose presence depends on the label (chi-square
    of at least ``least_chi`` with the texts of both labels weighted alike),
    the ``most_slots`` strongest: a rare term that fell to one side by chance
    would otherwise outweigh the few that matter, above all in long texts."""

    def __init__(self, rows: list[tuple[int, np.ndarray]] = (), **learning):
        seen, size = np.zeros((2, DIMENSIONS)), [0, 0]
        for label, slots in rows:
            seen[label, slots] += 1
            size[label] += 1
        if self.choose(seen, size, **{k: learning.pop(k) for k in ("least_docs", "least_chi", "most_slots") if k in learning}):
            sets = [self.ids(slots) for _, slots in rows]
            self.learn(np.array([label for label, _ in rows]), np.concatenate(sets), np.array([len(s) for s in sets]), **learning)

    def choose(self, seen: np.ndarray, size, least_docs: int = 4, least_chi: float = 12.0, most_slots: int = 1 << 14) -> bool:
        """Keep the slots that tell; ``seen``: texts of either label by slot, ``size``:
        texts of either label.  Whether there is anything to learn."""
        n = int(size[0]) + int(size[1])
        self.share = share = size[1] / n if n else 0.0
        self.slot, self.w0 = np.full(DIMENSIONS, -1, np.int32), None
        if not 0 < share < 1:
            return False
        p0, p1 = seen[0] / size[0], seen[1] / size[1]
        p = seen.sum(axis=0) / n
        chi = (p1 - p0) ** 2 * n * share * (1 - share) / np.maximum(p * (1 - p), 1e-12)
        chi[(seen.sum(axis=0) < least_docs) | (p >= 1)] = 0
        used = np.argsort(-chi, kind="stable")[:most_slots]
        used = np.sort(used[chi[used] >= least_chi])
        self.slot[used] = np.arange(len(used))
        return True

    def learn(self, y: np.ndarray, flat: np.ndarray, sizes: np.ndarray, factors: int = 4, rounds: int = 40,
              rate: float = 0.2, shrink: float = 1e-4) -> None:
        """``flat``: the ids of all texts one after the other, ``sizes`` of each."""
        share, ends = self.share, np.concatenate(([0], np.cumsum(sizes)))
        used = int(self.slot.max()) + 1
        weight = np.where(y == 1, math.sqrt((1 - share) / share), 1.0)
        chance = np.random.default_rng(7)
        self.w0, self.w = math.log(share / (1 - share)), np.zeros(used)
        self.v = chance.normal(0, 0.01, (used, factors))
        gw, gv = np.full(used, 1e-6), np.full((used, factors), 1e-6)
        for _ in range(rounds):
            order = chance.permutation(len(y))
            for at in range(0, len(order), 32):
                batch = [i for i in order[at: at + 32] if sizes[i]]
                if not batch:
                    continue
                ids = np.concatenate([flat[ends[i]: ends[i + 1]] for i in batch])
                lengths = sizes[batch]
                heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                v = self.v[ids]
                total = np.add.reduceat(v, heads)
                raw = self.w0 + np.add.reduceat(self.w[ids], heads) \
                    + 0.5 * ((total ** 2).sum(axis=1) - np.add.reduceat((v ** 2).sum(axis=1), heads))
                miss = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[batch]) * weight[batch]
                dv = np.repeat(miss, lengths)[:, None] * (np.repeat(total, lengths, axis=0) - v)
                slots, where = np.unique(ids, return_inverse=True)
                sw = np.bincount(where, np.repeat(miss, lengths), len(slots)) / len(batch) + shrink * self.w[slots]
                sv = np.stack([np.bincount(where, dv[:, f], len(slots)) for f in range(factors)], axis=1) / len(batch) \
                    + shrink * self.v[slots]
                gw[slots] += sw ** 2
                gv[slots] += sv ** 2
                self.w[slots] -= rate * sw / np.sqrt(gw[slots])
                self.v[slots] -= 0.1 * rate * sv / np.sqrt(gv[slots])
                self.w0 -= rate * 0.1 * float(miss.mean())

    def ids(self, slots: np.ndarray) -> np.ndarray:
        ids = self.slot[slots]
        return np.unique(ids[ids >= 0])

    def score(self, slots: np.ndarray) -> float:
        if self.w0 is None:
            return self.share
        ids = self.ids(slots)
        v = self.v[ids]
        raw = self.w0 + self.w[ids].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v ** 2).sum())
        return 1 / (1 + math.exp(-min(max(raw, -30), 30)))


def _term_sets(batches):
    for batch in batches:
        found = [np.unique(terms(t)).astype("<i4").tobytes() for t in byte_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("turn"), pa.array(found, pa.binary())],
                                         names=["label", "turn", "slots"])


def _term_counts(batches):
    """(label, slot, texts), summed a batch."""
    for batch in batches:
        labels, sets = batch.column("label").to_numpy(), [np.frombuffer(s.as_buffer(), "<i4") for s in batch.column("slots")]
        keys = np.concatenate([s.astype(np.int64) + (int(y) << BITS) for y, s in zip(labels, sets, strict=True)] or [np.empty(0, np.int64)])
        keys, n = np.unique(keys, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((keys >> BITS).astype(np.int32)), pa.array((keys & (DIMENSIONS - 1)).astype(np.int32)),
                                          pa.array(n.astype(np.int64))], names=["label", "slot", "n"])


def _kept_ids(slot: np.ndarray):
    def run(batches):
        for batch in batches:
            ids = [slot[np.frombuffer(s.as_buffer(), "<i4")] for s in batch.column("slots")]
            ids = [np.unique(i[i >= 0]).astype(np.int32) for i in ids]
            ends = np.cumsum([0] + [len(i) for i in ids])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("turn"), lists], names=["label", "turn", "ids"])
    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, **machine) -> Machine:
    """``docs``: doc_id, text; ``labels``: doc_id, label (0 or 1).  At most
    twice ``per_class`` labelled rows are learned."""
    turn = F.xxhash64("doc_id")
    known = labels.where("doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"), turn.alias("turn"))
    first = [known.where(f"label = {y}").orderBy("turn", "doc_id").limit(per_class) for y in (0, 1)]
    # At most two times per_class ids: small by their count, not by the corpus.
    chosen = F.broadcast(first[0].unionByName(first[1]))
    rows = staged(docs.join(chosen, "doc_id").select("label", "turn", "text").mapInArrow(_term_sets, "label int, turn long, slots binary"), "op2-terms")
    size = dict(rows.groupBy("label").count().collect())
    counts = rows.mapInArrow(_term_counts, "label int, slot int, n long").groupBy("label", "slot").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((2, DIMENSIONS))
    seen[counts["label"].to_numpy(), counts["slot"].to_numpy()] = counts["n"].to_numpy()
    del counts
    learning = {k: machine.pop(k) for k in ("least_docs", "least_chi", "most_slots") if k in machine}
    out = Machine()
    if out.choose(seen, (size.get(0, 0), size.get(1, 0)), **learning):
        del seen
        ids = rows.mapInArrow(_kept_ids(out.slot), "label int, turn long, ids array<int>").orderBy("turn", "label", "ids").toArrow()
        lists = ids["ids"].combine_chunks()
        out.learn(ids["label"].to_numpy(), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), **machine)
        del ids, lists
    dropped(rows)
    pa.default_memory_pool().release_unused()
    return out


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but text are dropped: doc_id, score, predicted."""
    def run(batches):
        for batch in batches:
            found = np.array([machine.score(terms(t)) for t in byte_texts(batch.column("text"))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "score", "predicted"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, score double, predicted int"))


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            found = np.array([machine.score(terms(t)) for t in byte_texts(column)], dtype=np.float64)
            yield batch.filter(pa.array(found < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` when divided by ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds == fold

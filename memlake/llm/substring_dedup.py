"""Operator 4, substring dedup by level-wise doubling.

A window is ``length`` consecutive words of one document.  Words covered by a
window whose word sequence also starts in a document with a smaller id are
removed.

Level 1 looks at windows of half the length, one per anchor (see
``windows``): a half window in a single document ends there.  Level 2 extends
the repeated half windows alone, on either side, to the full length.  First
all windows of one anchor are taken together (their common *reach*): equal
reaches share all their windows, so only the smallest id of a reach has to be
compared window by window, and only if its half window has other reaches.

Defined cases: null and empty texts have no words and come back with
``n_words`` 0; a row with a null id takes part in no comparison and keeps all
its words; rows that share an id are one document and must hold the same text;
a repeat inside one document removes nothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .batches import Out, byte_texts, listed, spread
from .common import dropped, id_text, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS = "b long, x long, doc_id long, lo int, hi int"


def _names(text: np.ndarray, length: int):
    """Names of the half windows and of the whole windows of one text."""
    import xxhash
    words = text.tobytes().split()
    half = (length + 1) // 2
    if len(words) < length:
        return None, None
    symbols = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    halves = W.gram_names(symbols, half)
    return halves, W.join_names(halves[: len(words) - length + 1], halves[length - half:])


def _reaches(length: int):
    span = length - (length + 1) // 2 + 1

    def run(batches):
        out = Out(b=pa.int64(), x=pa.int64(), doc_id=pa.int64(), lo=pa.int32(), hi=pa.int32())
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for doc_id, text in zip(ids, byte_texts(batch.column("text")), strict=True):
                halves, whole = _names(text, length)
                if whole is None:
                    continue
                at, lo, hi = W.anchors(halves, span)
                x = W.join_names(W.join_names(whole[lo], whole[hi]), (hi - lo).astype(np.uint64))
                out.add(halves[at], x, np.int64(doc_id), lo.astype(np.int32), hi.astype(np.int32))
                if out.full():
                    yield from out.take()
        yield from out.take()
    return run


def _whole_windows(length: int):
    def run(batches):
        out = Out(b=pa.int64(), x=pa.int64(), doc_id=pa.int64(), lo=pa.int32())
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            spots = listed(batch.column("spots"))
            for doc_id, text, found in zip(ids, byte_texts(batch.column("text")), spots, strict=True):
                _, whole = _names(text, length)
                if whole is None:
                    continue
                at, of = spread(found["lo"].astype(np.int64), found["hi"].astype(np.int64))
                out.add(found["b"][of], whole[at], np.int64(doc_id), at.astype(np.int32))
                if out.full():
                    yield from out.take()
        yield from out.take()
    return run


def _removal(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            ids, spots = batch.column("doc_id").to_pylist(), listed(batch.column("spots"))
            for doc_id, text, found in zip(ids, byte_texts(batch.column("text")), spots, strict=True):
                words, n_removed = text.tobytes().split(), 0
                n_words = len(words)
                if len(found["lo"]):
                    starts, ends = W.stretches(found["lo"].astype(np.int64), np.minimum(found["hi"].astype(np.int64) + length, n_words))
                    kept, at = [], 0
                    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                        kept += words[at:s]
                        at = e
                    kept += words[at:]
                    n_removed, words = n_words - len(kept), kept
                rows.append((doc_id, n_words, n_removed, b" ".join(words)))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in columns[3]], pa.string()),
                 pa.array(columns[3], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def repeated_windows(docs: DataFrame, length: int = 50) -> DataFrame:
    """Runs of window starts (doc_id, lo, hi) whose windows also start in a
    document with a smaller id.  ``docs`` has doc_id and text."""
    docs = docs.where("doc_id is not null and text is not null")
    rows = docs.mapInArrow(_reaches(length), _ROWS)

    # Level 1: half windows in two documents or more.
    shared = staged(rows.groupBy("b").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
                    .where("d0 < d1").select("b"), "op4-halves")
    rows = staged(rows.join(shared, "b"), "op4-rows")
    dropped(shared)

    # Level 2, by reach: a reach's copies all follow its smallest id.
    reach = staged(rows.groupBy("b", "x").agg(F.min("doc_id").alias("d0")), "op4-reaches")
    several = staged(reach.groupBy("b").count().where("count > 1").select("b", F.lit(True).alias("several")), "op4-several")
    kinds = staged(reach.join(several, "b", "left"), "op4-reach-kinds")
    found = staged(rows.join(kinds, ["b", "x"]).where("doc_id > d0 or several"), "op4-found")
    dropped(rows, reach, several, kinds)
    copies = found.where("doc_id > d0").select("doc_id", "lo", "hi")

    # Level 2, window by window, for the smallest ids of differing reaches.
    spots = found.where("doc_id = d0").groupBy("doc_id").agg(F.collect_list(F.struct("b", "lo", "hi")).alias("spots"))
    whole = staged(docs.join(spots, "doc_id").select("doc_id", "text", "spots")
                   .mapInArrow(_whole_windows(length), "b long, x long, doc_id long, lo int"), "op4-windows")
    first = staged(whole.groupBy("b", "x").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
                   .where("d0 < d1").drop("d1"), "op4-first")
    late = whole.join(first, ["b", "x"]).where("doc_id > d0").select("doc_id", "lo", F.col("lo").alias("hi"))
    removed = staged(copies.unionByName(late), "op4-removed")
    dropped(found, whole, first)
    return removed


def substring_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and
    kept_text (the kept words joined by one space)."""
    docs = id_text(docs, id_col, text_col)
    spots = (repeated_windows(docs, length).groupBy("doc_id")
             .agg(F.collect_list(F.struct("lo", "hi")).alias("spots")))
    return (docs.join(spots, "doc_id", "left").select("doc_id", "text", "spots")
            .mapInArrow(_removal(length),
                        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"))

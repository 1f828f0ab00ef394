"""Operator 10, suffix-array dedup by bucket-pointer refinement.

Texts are UTF-8 bytes.  Each byte covered by a string of ``length`` bytes that
also starts anywhere else (in the same document too) is removed.

Suffixes are put into buckets, and only buckets with two or more members are
refined.  A bucket identifier is a content name (see ``windows``), equal on all
executors, in place of a rank from a global sort; names of 2n bytes are made
from the identifiers at offsets i and i + n, so each round reuses the last one
(25, 50, 100, 200 bytes).  The rounds over the corpus are:

1. the 50-byte gram at each anchor: a gram found once ends there;
2. the *reach* of the anchor (all strings of ``length`` bytes that have it as
   their anchor, taken together): equal reaches repeat all their strings;
3. for grams with differing reaches, blocks of 16 consecutive starts, bucketed
   by the bytes that all 16 strings share;
4. single starts, for blocks that share those bytes but still differ.

Rounds 3 and 4 see one member of a repeated reach or block, as a witness.

Defined cases: null and empty texts have no bytes (``n_bytes`` 0); a row with a
null id takes part in no comparison and keeps all its bytes; two rows that
share an id must hold the same text and repeat each other; further columns are
ignored.  ``length`` is 4 times ``gram`` / 2, 200 by default.
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

_BLOCK = 16
_ROWS = "b long, x long, n long, doc_id long, lo int, hi int, own boolean"


def _types() -> dict:
    return dict(b=pa.int64(), x=pa.int64(), n=pa.int64(), doc_id=pa.int64(), lo=pa.int32(), hi=pa.int32(), own=pa.bool_())


def _names(text: np.ndarray, quarter: int):
    """(symbols, bucket identifiers at length/4, at length) of one text."""
    if len(text) < 8 * quarter:
        return None, None, None
    symbols = text.astype(np.uint64) + np.uint64(1)
    names = W.gram_names(symbols, quarter)
    gram = names = W.doubled(names, quarter)
    names = W.doubled(names, 2 * quarter)
    return symbols, gram, W.doubled(names, 4 * quarter)


def _span_names(whole, lo, hi):
    return W.join_names(W.join_names(whole[lo], whole[hi]), (hi - lo).astype(np.uint64))


def _reaches(quarter: int):
    def run(batches):
        out = Out(**_types())
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for doc_id, text in zip(ids, byte_texts(batch.column("text")), strict=True):
                _, gram, whole = _names(text, quarter)
                if whole is None:
                    continue
                at, lo, hi = W.anchors(gram, 6 * quarter + 1)
                out.add(gram[at], _span_names(whole, lo, hi), np.int64(1), np.int64(doc_id),
                        lo.astype(np.int32), hi.astype(np.int32), np.bool_(True))
                if out.full():
                    yield from out.take()
        yield from out.take()
    return run


def _blocks(quarter: int):
    """Blocks of starts, laid out from the anchor so that equal strings fall
    into the same block; bucketed by what all strings of a block share."""
    def run(batches):
        out = Out(**_types())
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            spots = listed(batch.column("spots"))
            for doc_id, text, found in zip(ids, byte_texts(batch.column("text")), spots, strict=True):
                symbols, gram, whole = _names(text, quarter)
                if whole is None:
                    continue
                at, first, _ = W.anchors(gram, 6 * quarter + 1)
                shared = W.gram_names(symbols, 8 * quarter - _BLOCK + 1)
                lo, hi = found["lo"].astype(np.int64), found["hi"].astype(np.int64)
                p = at[np.searchsorted(first, lo, side="right") - 1]
                block, of = spread((lo - p) // _BLOCK, (hi - p) // _BLOCK)
                block = block * _BLOCK + p[of]
                lo, hi = np.maximum(block, lo[of]), np.minimum(block + _BLOCK - 1, hi[of])
                out.add(W.join_names(shared[block + _BLOCK - 1], found["b"].view(np.uint64)[of]), _span_names(whole, lo, hi),
                        found["n"][of], np.int64(doc_id), lo.astype(np.int32), hi.astype(np.int32), found["own"][of])
                if out.full():
                    yield from out.take()
        yield from out.take()
    return run


def _starts(quarter: int):
    def run(batches):
        out = Out(**_types())
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            spots = listed(batch.column("spots"))
            for doc_id, text, found in zip(ids, byte_texts(batch.column("text")), spots, strict=True):
                _, _, whole = _names(text, quarter)
                if whole is None:
                    continue
                at, of = spread(found["lo"].astype(np.int64), found["hi"].astype(np.int64))
                start = at.astype(np.int32)
                out.add(found["b"][of], whole[at], found["n"][of], np.int64(doc_id), start, start, found["own"][of])
                if out.full():
                    yield from out.take()
        yield from out.take()
    return run


def _refined(rows: DataFrame, tag: str):
    """One round.  ``rows``: bucket b, name x of the strings from lo to hi, n
    occurrences, own (still undecided) or witness.  Returns the rows found
    repeated, the rows that the next round has to look into, and the table
    behind both."""
    held = staged(rows.groupBy("b").agg(F.sum("n").alias("k")).where("k > 1").select("b"), f"op10-{tag}-held")
    rows = staged(rows.join(held, "b"), f"op10-{tag}-rows")
    kinds = staged(rows.groupBy("b", "x").agg(F.sum("n").alias("n_all"), F.min(F.struct("doc_id", "lo")).alias("rep")),
                   f"op10-{tag}-kinds")
    several = staged(kinds.groupBy("b").count().where("count > 1").select("b", F.lit(True).alias("several")),
                     f"op10-{tag}-several")
    marked = staged(kinds.join(several, "b", "left").where("n_all > 1 or several"), f"op10-{tag}-marked")
    found = staged(rows.join(marked, ["b", "x"])
                   .select("b", "doc_id", "lo", "hi", "own", "n_all", F.coalesce("several", F.lit(False)).alias("several"),
                           (F.struct("doc_id", "lo") == F.col("rep")).alias("is_rep")), f"op10-{tag}-found")
    dropped(held, rows, kinds, several, marked)
    rest = (found.where("several and (n_all = 1 or is_rep)")
            .select("b", "doc_id", "lo", "hi", F.least("n_all", F.lit(2)).alias("n"), (F.col("own") & (F.col("n_all") == 1)).alias("own")))
    return found.where("own and n_all > 1").select("doc_id", "lo", "hi"), rest, found


def _listed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("b", "lo", "hi", "n", "own")).alias("spots"))


def repeated_strings(docs: DataFrame, length: int = 200) -> DataFrame:
    """Runs of starts (doc_id, lo, hi) of strings of ``length`` bytes that
    start elsewhere too."""
    if length % 8 or length < 2 * _BLOCK:
        raise ValueError(f"length must be a multiple of 8 and at least {2 * _BLOCK}")
    quarter = length // 8
    docs = docs.where("doc_id is not null and text is not null")
    reaches, rest, found = _refined(docs.mapInArrow(_reaches(quarter), _ROWS), "reach")
    texts = staged(docs.join(_listed(rest), "doc_id").select("doc_id", "text", "spots"), "op10-texts")
    rows = staged(texts.mapInArrow(_blocks(quarter), _ROWS), "op10-blocks")
    blocks, rest, found_blocks = _refined(rows, "block")
    dropped(rows)
    starts = (texts.drop("spots").join(_listed(rest), "doc_id").select("doc_id", "text", "spots")
              .mapInArrow(_starts(quarter), _ROWS))
    starts = staged(starts, "op10-starts")
    dropped(texts)
    twice = staged(starts.groupBy("b", "x").agg(F.sum("n").alias("n_all")).where("n_all > 1").drop("n_all"), "op10-twice")
    single = starts.where("own").join(twice, ["b", "x"]).select("doc_id", "lo", "hi")
    removed = staged(reaches.unionByName(blocks).unionByName(single), "op10-removed")
    dropped(found, found_blocks, starts, twice)
    return removed


def _removal(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            ids, spots = batch.column("doc_id").to_pylist(), listed(batch.column("spots"))
            for doc_id, text, found in zip(ids, byte_texts(batch.column("text")), spots, strict=True):
                kept, n_spans = text, 0
                if len(found["lo"]):
                    starts, ends = W.stretches(found["lo"].astype(np.int64),
                                               np.minimum(found["hi"].astype(np.int64) + length, len(text)))
                    keep = np.ones(len(text), bool)
                    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                        keep[s:e] = False
                    kept, n_spans = text[keep], len(starts)
                kept = kept.tobytes()
                rows.append((doc_id, len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])
    return run


def suffix_dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and kept_bytes (cuts may fall inside a UTF-8
    character, so what is left is binary)."""
    docs = id_text(docs, id_col, text_col)
    spots = repeated_strings(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spots"))
    return (docs.join(spots, "doc_id", "left").select("doc_id", "text", "spots")
            .mapInArrow(_removal(length), "doc_id long, n_bytes long, n_removed long, n_spans long,"
                                          " kept_sha256 string, kept_bytes binary"))

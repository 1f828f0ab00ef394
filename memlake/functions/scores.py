"""Scores of all units that a row holds, in the task that has the row."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of an output batch.
OUT = 1 << 17
ROLES = ("all", "any", "none")


def _numbers(table: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row by the (non-null) values of some columns, and a row of each number."""
    code = np.zeros(table.num_rows, np.int64)
    for c in columns:
        held = pc.dictionary_encode(table.column(c).combine_chunks())
        code = np.unique(code * max(1, len(held.dictionary)) + held.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return number, first


def _at(begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins, size)


def row_scores(units: pa.Table, scope: list[str], by: list[str], k1: float, b: float):
    """An ``applyInArrow`` function from ``(bucket, …by, id, number, tf, created_at)``,
    the hits of rows and, under number -1, their lengths, to ``(…scope, id, score,
    created_at)`` of the rows that satisfy a query.

    ``units``: ``(…scope, number, term, role, repeats, n_all, n_any, idf, avgdl)``.
    Scores are summed in the order of terms."""
    turn = sorted(range(units.num_rows), key=lambda i, t=units.column("term").to_pylist(), r=units.column("repeats").to_pylist(): (t[i].encode(), r[i]))
    units = units.take(pa.array(turn, pa.int64()))
    query, first = _numbers(units, scope)
    queries = units.select(scope).take(pa.array(first)).combine_chunks()
    role = np.array([ROLES.index(r) for r in units.column("role").to_pylist()], np.int8)
    number, repeats, idf, avgdl = (units.column(c).to_numpy() for c in ("number", "repeats", "idf", "avgdl"))
    n_all, n_any = (units.column(c).to_numpy()[first] for c in ("n_all", "n_any"))
    of_number = np.argsort(number, kind="stable")           # units of a number; they stay in the order of terms
    sorted_number = number[of_number]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        row, _ = _numbers(table, [*by, "id"])
        tf, hit = table.column("tf").to_numpy(), table.column("number").to_numpy()
        lengths = np.flatnonzero(hit < 0)
        length, place = np.zeros(int(row.max()) + 1, np.int64), np.full(int(row.max()) + 1, -1)
        length[row[lengths]], place[row[lengths]] = tf[lengths], lengths
        hits = np.flatnonzero((hit >= 0) & (place[row] >= 0))
        # Every unit that asks for a hit.
        begin, end = (np.searchsorted(sorted_number, hit[hits], side=s) for s in ("left", "right"))
        unit = of_number[_at(begin, end - begin)]
        of = np.repeat(row[hits], end - begin)
        held = np.repeat(tf[hits], end - begin)
        order = np.lexsort((unit, query[unit], of))
        unit, of, held = unit[order], of[order], held[order]
        if not len(unit):
            return
        asked = query[unit]
        new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (asked[1:] != asked[:-1]))))
        got = [np.add.reduceat(role[unit] == k, new, dtype=np.int64) for k in range(len(ROLES))]
        q, r = asked[new], of[new]
        full = (got[0] == n_all[q]) & (got[2] == 0) & ((n_any[q] == 0) | (got[1] > 0)) & (got[0] + got[1] > 0)
        # One unit of each pair after the other.
        pair = np.repeat(np.where(full, np.cumsum(full) - 1, -1), np.diff(np.append(new, len(unit))))
        counted = np.flatnonzero((pair >= 0) & (role[unit] != 2))
        pair, unit, held, dl = pair[counted], unit[counted], held[counted], length[of[counted]]
        part = repeats[unit] * (idf[unit] * (held * (k1 + 1)) / (held + k1 * (1 - b + b * dl / avgdl[unit])))
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
        step = np.arange(len(pair)) - np.repeat(starts, np.diff(np.append(starts, len(pair))))
        score = np.zeros(int(full.sum()))
        turn = np.argsort(step, kind="stable")
        ends = np.cumsum(np.bincount(step)) if len(step) else []
        for i, j in zip([0, *ends], ends):      # noqa: B905
            score[pair[turn[i:j]]] += part[turn[i:j]]
        q, r = q[full], place[r[full]]
        for i in range(0, len(q), OUT):
            some, at = pa.array(q[i: i + OUT]), pa.array(r[i: i + OUT])
            out = [*queries.take(some).columns, table.column("id").take(at), pa.chunked_array([score[i: i + OUT]]), table.column("created_at").take(at)]
            yield from pa.Table.from_arrays(out, names=[*scope, "id", "score", "created_at"]).combine_chunks().to_batches()
    return run


def unit_hits(units: pa.Table, fields: list[str]):
    """A ``mapInArrow`` function from postings ``(id, term, …fields)``, the fields
    as how often each holds the term, to ``(term, id, tf)`` of units of one token:
    ``(unit, token, prefix, field)``.  A row's hits are added up as far as its
    postings lie together."""
    asked = units.column("unit").combine_chunks()
    prefix = np.array(units.column("prefix").to_pylist(), bool)
    token = units.column("token").to_pylist()
    size = np.array([len(t) for t in token])
    weights = np.array([[f is None or f == name for name in fields] for f in units.column("field").to_pylist()], np.int64).reshape(len(token), len(fields))
    kinds = []
    for length in [0, *sorted(set(size[prefix].tolist()))]:     # 0: whole tokens
        of = np.flatnonzero(prefix & (size == length) if length else ~prefix)
        words = sorted({token[i] for i in of})
        number = {w: n for n, w in enumerate(words)}
        mine = np.array([number[token[i]] for i in of], np.int64)
        turn = np.argsort(mine, kind="stable")
        kinds.append((length, pa.array(words, pa.string()), of[turn], np.searchsorted(mine[turn], np.arange(len(words) + 1))))

    def found(table):
        terms = pc.dictionary_encode(table.column("term").combine_chunks())
        names, at = terms.dictionary, terms.indices.to_numpy(zero_copy_only=False)
        ids = pc.dictionary_encode(table.column("id").combine_chunks(), null_encoding="encode")
        rows = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.stack([table.column(f).to_numpy() for f in fields], axis=1).astype(np.int64)
        keys, counts = [], []
        for length, words, of, begins in kinds:
            if len(words):
                match = pc.index_in(pc.utf8_slice_codeunits(names, 0, length) if length else names, words).fill_null(-1).to_numpy(zero_copy_only=False)[at]
                here = np.flatnonzero(match >= 0)
                many = begins[match[here] + 1] - begins[match[here]]
                unit = of[_at(begins[match[here]], many)]
                place = np.repeat(here, many)
                keys.append(unit * len(ids.dictionary) + rows[place])
                counts.append((held[place] * weights[unit]).sum(axis=1))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys[counts > 0], kind="stable")
        keys, counts = keys[counts > 0][order], counts[counts > 0][order]
        if len(keys):
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            unit, row = np.divmod(keys[new], len(ids.dictionary))
            yield from pa.Table.from_arrays([asked.take(pa.array(unit)), ids.dictionary.take(pa.array(row)), pa.array(np.add.reduceat(counts, new))],
                                            names=["term", "id", "tf"]).combine_chunks().to_batches(max_chunksize=OUT)

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= OUT:
                yield from found(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if size:
            yield from found(pa.Table.from_batches(waiting))
    return run

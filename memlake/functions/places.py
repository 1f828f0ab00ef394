"""Postings of whole rows: the tokens of a row grouped by term inside the task
that holds the row, so that no token is shuffled or sorted with others."""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from memlake.functions.stemming import stem_word

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens as ``text.fts_tokens`` cuts them.
TOKEN = re.compile("[a-z0-9\x80-\U0010ffff]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
#: Tokens of a batch of postings, and different ones that a task remembers.
PART, TERMS = 1 << 18, 1 << 18


def _tokens(text: str | None) -> list[str]:
    text = text or ""
    return TOKEN.findall(text.lower() if text.isascii() else text.translate(_FOLD))


class _Terms(dict):
    """Numbers of tokens, by term or by stem, in the order they are met."""

    def __init__(self, stem: bool):
        self.names, self.numbers, self.stem = [], {}, stem

    def __missing__(self, token):
        term = stem_word(token) if self.stem else token
        number = self.numbers.setdefault(term, len(self.names))
        if number == len(self.names):
            self.names.append(term)
        self[token] = number
        return number


def _grouped(batch, keys, fields, terms, rows, tags, numbers, lengths):
    """The postings of the token lists ``lengths`` (of row and field)."""
    lengths = np.array(lengths, np.int64)
    number = np.concatenate(numbers)
    place = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = (np.repeat(np.array(rows, np.int64), lengths) << 32) | number
    order = np.argsort(key, kind="stable")          # places stay ascending, the fields in turn
    key, tag, place = key[order], np.repeat(np.array(tags, np.int8), lengths)[order], place[order].astype(np.int32)
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lists = []
    for f in range(len(fields)):
        offsets = np.concatenate((np.concatenate(([0], np.cumsum(tag == f)))[begins], [(tag == f).sum()])).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(offsets, place[tag == f]))
    row = pa.array(key[begins] >> 32)
    used, at = np.unique(key[begins] & 0xFFFFFFFF, return_inverse=True)
    names = pa.array([terms.names[n] for n in used], pa.string()).take(pa.array(at))
    tf = np.diff(np.concatenate((begins, [len(key)])))
    return pa.RecordBatch.from_arrays([*[batch.column(k).take(row) for k in keys], names, pa.array(tf), *lists],
                                      names=[*keys, "term", "tf", *[f"{f}_at" for f in fields]])


def row_postings(keys: list[str], fields: list[str], stem: bool):
    """A ``mapInArrow`` function from ``(…keys, …fields)`` to ``(…keys, term,
    tf, …fields_at)``; places are ascending, and begin at 0 in each field."""
    def run(batches):
        terms = _Terms(stem)
        for batch in batches:
            held, size = ([], [], [], []), 0
            for i in range(batch.num_rows):
                for f, name in enumerate(fields):
                    tokens = _tokens(batch.column(name)[i].as_py())
                    if tokens:
                        number = np.fromiter(map(terms.__getitem__, tokens), np.int64, len(tokens))
                        for x, value in zip(held, (i, f, number, len(tokens)), strict=True):
                            x.append(value)
                        size += len(tokens)
                if size and (size >= PART or i == batch.num_rows - 1):
                    yield _grouped(batch, keys, fields, terms, *held)
                    held, size = ([], [], [], []), 0
                if not size and len(terms) > TERMS:
                    terms = _Terms(stem)
    return run

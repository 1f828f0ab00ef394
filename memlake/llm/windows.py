"""Fixed-length window names and content-chosen anchors, one document at a time.

A *name* is a 64-bit content hash: equal strings get equal names on every
executor, so buckets of equal strings need no global sort.  Names of length
2n come from two names of length n (``names[i]``, ``names[i + n]``).

An *anchor* is the gram with the smallest name in a window (leftmost on ties).
Which gram that is depends on the window's content alone, so equal windows have
their anchor at the same place.  Every window belongs to exactly one anchor;
the windows of one anchor are consecutive starts ``lo..hi``.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2^64
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0xA0761D6478BD642F) + mix(b + _U(0x8EBC6AF09C88C6E3)))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=_U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[kind] = have
    return have[:n]


def gram_names(symbols: np.ndarray, length: int) -> np.ndarray:
    """Names of all grams of ``length`` symbols (a prefix-sum polynomial hash,
    then mixed); ``symbols`` are uint64."""
    n = len(symbols)
    if n < length:
        return np.empty(0, _U)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(symbols * _power("up", _BASE, n), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * _power("down", _INVERSE, n)[: n - length + 1] + _U(length))


def doubled(names: np.ndarray, length: int) -> np.ndarray:
    """Names of length ``2 * length`` from names of ``length``."""
    return join_names(names[:-length], names[length:]) if len(names) > length else np.empty(0, _U)


def anchors(grams: np.ndarray, span: int):
    """For each run of ``span`` consecutive grams the position of its smallest
    name.  Returns (anchor position, first run, last run) per anchor."""
    n = len(grams)
    bits = _U(max(24, int(n).bit_length()))
    low = (grams >> bits << bits) | np.arange(n, dtype=_U)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width:])
    at = (low & ((_U(1) << bits) - _U(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return at[first], first, last


def stretches(starts: np.ndarray, ends: np.ndarray):
    """Union of half-open intervals as sorted disjoint (start, end) arrays;
    touching intervals join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    head = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[head], ends[np.concatenate((np.flatnonzero(head)[1:] - 1, [len(ends) - 1]))]

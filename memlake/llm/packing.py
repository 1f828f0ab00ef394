"""Operator 8, packing by best-fit decreasing.

A document is its token ids followed by one end id.  Documents longer than a
window are first cut into full windows, each a sequence of its own; the rest
pieces are placed, longest first, into the open window with the least room
that still holds them.  The open windows are found with a segment tree over
the remaining capacities 0..window.

Tasks encode whole texts and give numbers only: the full windows, and the rest
pieces with a number of their own.  These are written, counted, and dealt by a
hash of their number to groups of about ``GROUP`` pieces, whatever the files or
splits of the input were; each group is packed by itself (six numbers a piece
in memory).  A hot id or repeated text cannot fill a group, as the numbers are
distinct.  The last windows of a group are the only ones that more pieces could
have filled.  Sequence ids are partition number times 2^33 plus a count, those
of groups with bit 32 set.

A text is encoded as a whole, so a task holds the longest text and its ids.

Defined cases: null and empty texts are the end id alone, one piece of length
1; repeated rows and ids are packed once per row; pieces of equal length are
placed in the order of (doc_id, start), null ids last; further columns are
ignored; an empty table gives an empty table.

Ids are those of the tokenizers library with the vocabulary file.  Texts of
Latin characters (below U+0240) without ``<|`` are encoded with the same
vocabulary by tiktoken, which gives the same ids (tested) four times as fast.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import byte_texts
from .common import id_text, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 0
#: Rest pieces packed together, on average.
GROUP = 50_000
_encoders: dict = {}


class OpenWindows:
    """Open windows by remaining capacity: ``fit(n)`` takes the one with the
    least capacity >= n (or opens one) and gives (window, offset).  The tree's
    inner nodes say whether any window of their capacity range is open."""

    def __init__(self, window: int):
        self.window, self.leaves = window, 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]
        self.count = 0

    def _add(self, capacity: int, change: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += change
            node >>= 1

    def _tightest(self, least: int) -> int | None:
        node, tree = least + self.leaves, self.open
        while not tree[node]:
            while node & 1:             # a right child: nothing further right below its parent
                node >>= 1
            if not node:
                return None
            node += 1                   # the right sibling
        while node < self.leaves:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self.leaves

    def fit(self, length: int) -> tuple[int, int]:
        capacity = self._tightest(length)
        if capacity is None:
            place, capacity = self.count, self.window
            self.count += 1
        else:
            place = self.held[capacity].pop()
            self._add(capacity, -1)
        left = capacity - length
        if left:
            self.held[left].append(place)
            self._add(left, 1)
        return place, self.window - capacity


def _encoder(json_path: str | None, ranks_path: str | None):
    """A function from the UTF-8 bytes of a text to its ids (uint32)."""
    key = (json_path, ranks_path)
    if key in _encoders:
        return _encoders[key]
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: np.ndarray) -> np.ndarray:
        if not len(text):
            return np.empty(0, np.uint32)
        raw = text.tobytes()
        if text.max() <= 0xC8 and b"<|" not in raw:
            return quick.encode_to_numpy(raw.decode(), disallowed_special=())
        return np.array(whole.encode(raw.decode(), add_special_tokens=False).ids, dtype=np.uint32)

    _encoders[key] = encode
    return encode


_TYPES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
          "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


_SCHEMA = ", ".join(f"`{c}` long" for c in _TYPES)


def _pieces(window: int, end_id: int, json_path: str | None, ranks_path: str | None):
    """Full windows, and rest pieces with a number of their own as ``sequence_id`` and no ``offset``."""
    def run(batches):
        from pyspark import TaskContext
        encode = _encoder(json_path, ranks_path)
        number = TaskContext.get().partitionId() << 33
        schema = pa.schema(list(_TYPES.items()))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start: start + window]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), number,
                                 0 if len(piece) == window else None))
                    number += 1
            yield pa.RecordBatch.from_pylist([dict(zip(_TYPES, r, strict=True)) for r in rows], schema)
    return run


def _group_packed(window: int):
    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        number = key[0].as_py() << 33 | 1 << 32
        pieces = pieces.select(list(_TYPES)).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
                                                      ("sequence_id", "ascending")])
        windows = OpenWindows(window)
        placed = [windows.fit(length) for length in pieces.column("length").to_pylist()]
        columns = {c: pieces.column(c) for c in _TYPES}
        columns["sequence_id"] = pa.array([number + place for place, _ in placed], pa.int64())
        columns["offset"] = pa.array([offset for _, offset in placed], pa.int64())
        return pa.table(columns)
    return run


def pack(docs: DataFrame, window: int = 1024, end_id: int = END_ID, json_path: str | None = None,
         ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    pieces = id_text(docs, id_col, text_col).mapInArrow(_pieces(window, end_id, json_path, ranks_path), _SCHEMA)
    pieces = staged(pieces, "op8-pieces")
    rest = pieces.where("offset is null")
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumn("_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    packed = rest.groupBy("_group").applyInArrow(_group_packed(window), _SCHEMA)
    return pieces.where("offset is not null").unionByName(packed)

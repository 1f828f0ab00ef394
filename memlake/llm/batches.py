"""Arrow batches of (doc_id, text) as byte arrays, and output batches back."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows gathered before an output batch is handed to Spark.
OUT_ROWS = 100_000


def byte_texts(column: pa.Array):
    """Each text of ``column`` as a uint8 view of its UTF-8 bytes (null: empty)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[offsets[i]: offsets[i + 1]] if valid[i] else data[:0]


class Out:
    """Collects equally long arrays per document into output batches."""

    def __init__(self, **types):
        self.schema = pa.schema(list(types.items()))
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, *arrays) -> None:
        n = max(len(a) for a in arrays if not np.isscalar(a))
        if n:
            self.parts.append(tuple(np.full(n, a) if np.isscalar(a) else a for a in arrays))
            self.rows += n

    def full(self) -> bool:
        return self.rows >= OUT_ROWS

    def take(self) -> list[pa.RecordBatch]:
        if not self.rows:
            return []
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.rows = [], 0
        arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, type=f.type)
                  for c, f in zip(columns, self.schema, strict=True)]
        return [pa.RecordBatch.from_arrays(arrays, schema=self.schema)]


def listed(column: pa.Array):
    """Each row's list of structs as a dict of numpy arrays (null: empty)."""
    offsets = column.offsets.to_numpy()
    fields = {f.name: column.values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(column.type.value_type)}
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        at = slice(offsets[i], offsets[i + 1] if valid[i] else offsets[i])
        yield {k: v[at] for k, v in fields.items()}


def spread(lo: np.ndarray, hi: np.ndarray):
    """All numbers lo..hi of each range, and the range that each is from."""
    size = hi - lo + 1
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of], of

"""Set similarity in tasks: which sets meet in a word of their prefixes, and how
many words the sets of a pair share.

Words are 64-bit hashes.  The low 32 bits name a word where sets meet (two words
of one name only make sets meet once more), the low ``CLASS_BITS`` its class,
and the high 32 its place in a sketch."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASS_BITS = 20
EPS = 1e-9
#: 64-bit words of a short sketch.
SHORT, SHORT_BITS = 4, 8
#: Sets that may hold a word before those that meet in it are dealt to pairs of blocks.
HOT = 1 << 15
#: Meetings that are looked at together, and rows of an output batch.
PART, OUT = 1 << 18, 1 << 17
_SET = np.dtype([("gid", "<i8"), ("n", "<i4"), ("m", "<i4"), ("rows", "<i4"), ("bits", "u1"), ("probe", "?")])
_ROW = np.dtype([("w", "<u4"), ("before", "<u4"), ("at", "<i4"), ("side", "u1")])


def _spread(size: np.ndarray) -> np.ndarray:
    """0 .. size - 1 of each size."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of lists, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def slots(batches):
    """``(slot, df)``: words of each class, from lists of hashes."""
    total = np.zeros(1 << CLASS_BITS, np.int64)
    for batch in batches:
        words, _ = _lists(batch.column(0))
        total += np.bincount((words & np.uint64(len(total) - 1)).astype(np.int64), minlength=len(total))
    used = np.flatnonzero(total)
    for at in range(0, len(used), OUT):
        part = used[at: at + OUT]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "df"])


def among(gids: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether the slot of each number is held."""
    return held[(_mixed(gids.astype(np.uint64)) & np.uint64(len(held) - 1)).astype(np.int64)]


def kept(held: np.ndarray):
    """Rows whose number, in the first column, has a held slot."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(among(batch.column(0).to_numpy(), held)))
    return run


def number_slots(size: int):
    """The slots, of ``size``, of the numbers in the first column."""
    def run(batches):
        held = np.zeros(size, bool)
        for batch in batches:
            held[(_mixed(batch.column(0).to_numpy().astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held))], names=["slot"])
    return run


def deal(threshold: float, counts: np.ndarray, buckets: int, probes: np.ndarray | None):
    """A ``mapInArrow`` function from ``(gid, words)`` to ``(bucket, sets, rows,
    sketches)``: the words in the prefix of every set, dealt by word.

    The order of words is that of their class's count, then of their name; a
    word of a class that counts one is held by its set alone and meets none.
    Each word goes with the one before it, each set of a bucket with its sketch:
    bit h tells whether an odd number of its words hash to h, of at least as many
    bits as it has words that others may hold."""
    def run(batches):
        for batch in batches:
            words, size = _lists(batch.column("words"))
            if not len(words):
                continue
            of = np.repeat(np.arange(len(size)), size)
            name = (words & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            count = counts[name & np.uint32(len(counts) - 1)]
            order = np.lexsort((name, count, of))
            name, count, high = name[order], count[order], (words[order] >> np.uint64(32)).astype(np.int64)
            at = _spread(size)
            shared = count > 1
            before = np.zeros(len(name), np.uint32)
            before[1:] = np.where((of[1:] == of[:-1]) & shared[:-1], name[:-1], 0)
            m = np.bincount(of[shared], minlength=len(size))
            bits = np.maximum(SHORT_BITS, np.ceil(np.log2(np.maximum(m, 1)))).astype(np.int64)
            sets = np.zeros(len(size), _SET)
            sets["gid"], sets["n"], sets["m"], sets["bits"] = batch.column("gid").to_numpy(), size, m, bits
            sets["probe"] = True if probes is None else among(sets["gid"], probes)
            begins = np.concatenate(([0], np.cumsum(1 << bits)))
            odd = np.bincount(begins[of[shared]] + (high[shared] & ((1 << bits[of[shared]]) - 1)), minlength=begins[-1]) & 1
            sketch, begins = np.packbits(odd.astype(np.uint8), bitorder="little"), begins // 8

            taken = np.flatnonzero(shared & (at < (size - np.ceil(size * threshold - EPS) + 1)[of]))
            # Words of very many sets: blocks of sets, each with each.
            blocks = -(-count[taken].astype(np.int64) // HOT)
            of_row = np.repeat(taken, blocks)
            mine = (_mixed(sets["gid"][of[of_row]].astype(np.uint64)) % np.repeat(blocks, blocks).astype(np.uint64)).astype(np.int64)
            other = _spread(blocks)
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            key = name[of_row].astype(np.uint64) << np.uint64(32) ^ low.astype(np.uint64) << np.uint64(16) ^ high.astype(np.uint64)
            rows = np.zeros(len(of_row), _ROW)
            rows["w"], rows["before"], rows["at"] = name[of_row], before[of_row], at[of_row]
            rows["side"] = np.where(mine == other, 0, np.where(mine < other, 1, 2))
            split = np.repeat(blocks, blocks) > 1
            rows["w"][split] = _mixed(key[split]).astype(np.uint32)
            bucket = (_mixed(key) % np.uint64(buckets)).astype(np.int64)
            turn = np.lexsort((of[of_row], bucket))
            rows, bucket, of_row = rows[turn], bucket[turn], of[of_row[turn]]
            # One entry a set and bucket.
            new = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (of_row[1:] != of_row[:-1])))) if len(rows) else np.empty(0, np.int64)
            entries = sets[of_row[new]]
            entries["rows"] = np.diff(np.append(new, len(rows)))
            for b in np.unique(bucket):
                e0, e1 = np.searchsorted(bucket[new], (b, b + 1))
                r0, r1 = np.searchsorted(bucket, (b, b + 1))
                held = of_row[new[e0:e1]]
                width = begins[held + 1] - begins[held]
                marks = sketch[np.repeat(begins[held], width) + _spread(width)]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (entries[e0:e1], rows[r0:r1], marks)]],
                                                 names=["bucket", "sets", "rows", "sketches"])
    return run


class _Sketches:
    """Sketches of several lengths; a longer one is folded to a shorter."""

    def __init__(self, marks: np.ndarray, bits: np.ndarray):
        marks, width = marks.view(np.uint64), (1 << bits) // 64
        begins = np.cumsum(width) - width
        self.bits, self.place, self.tables = bits, np.zeros(len(bits), np.int64), {}
        for own in np.unique(bits).tolist():
            here = np.flatnonzero(bits == own)
            self.place[here] = np.arange(len(here))
            self.tables[own, own] = marks[begins[here][:, None] + np.arange((1 << own) // 64)]

    def folded(self, own: int, bits: int) -> np.ndarray:
        """All of a length, in fewer bits."""
        if (own, bits) not in self.tables:
            table = self.tables[own, own]
            self.tables[own, bits] = np.bitwise_xor.reduce(table.reshape(len(table), -1, (1 << bits) // 64), axis=1)
        return self.tables[own, bits]

    def short(self) -> np.ndarray:
        out = np.zeros((len(self.bits), SHORT), np.uint64)
        for own in np.unique(self.bits).tolist():
            out[self.bits == own] = self.folded(own, SHORT_BITS)
        return out

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of pairs differ."""
        out, kinds = np.zeros(len(a), np.int64), self.bits[a] << 8 | self.bits[b]
        for kind in np.unique(kinds).tolist():
            x, y = kind >> 8, kind & 255
            bits, every = min(x, y), np.flatnonzero(kinds == kind)
            step = max(1, (1 << 26) >> bits)
            for i in range(0, len(every), step):
                here = every[i: i + step]
                out[here] = np.bitwise_count(self.folded(x, bits)[self.place[a[here]]] ^ self.folded(y, bits)[self.place[b[here]]]).sum(axis=1, dtype=np.int32)
        return out


def meetings(threshold: float):
    """An ``applyInArrow`` function from the rows of a bucket to pairs ``(ka, kb,
    na, nb, both, x0 ..)`` that may share ``threshold / (1 + threshold)`` of their
    words: x is where their short sketches differ, both their shared words.

    ``a`` is the smaller set.  Sets that share the word before this one as well
    meet there, so each pair is returned for the first shared word at least.
    Bounds on the overlap: the words up to this one and after it, on either side,
    and half of the words less the bits in which sketches longer than the short
    ones differ, as each such bit takes a word that one of the sets lacks."""
    names = ["ka", "kb", "na", "nb", "both", *[f"x{k}" for k in range(SHORT)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        sets, rows, marks = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("sets", _SET), ("rows", _ROW), ("sketches", np.uint8)))
        del table
        sketches = _Sketches(marks, sets["bits"].astype(np.int64))
        short = sketches.short()
        gid, n, m, probe = sets["gid"], sets["n"].astype(np.int64), sets["m"].astype(np.int64), sets["probe"]
        entry = np.repeat(np.arange(len(sets)), sets["rows"])
        order = np.lexsort((gid[entry], n[entry], rows["w"]))
        rows, entry = rows[order], entry[order]
        w, at, before, side, size = rows["w"].astype(np.int64), rows["at"].astype(np.int64), rows["before"], rows["side"], n[entry]
        # The rows before each one that hold its word and are large enough.
        span = int(n.max()) + 2
        begin = np.searchsorted(w * span + size, w * span + np.ceil(size * threshold - EPS).astype(np.int64))
        many, split = np.arange(len(rows)) - begin, side.any()
        ends = np.cumsum(many)

        def parts():
            i = 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PART, side="right")))
                if j > i + 1:
                    b = np.repeat(np.arange(i, j), many[i:j])
                    yield _spread(many[i:j]) + begin[b], b
                else:                                               # one row may meet more than a part
                    for first in range(begin[i], i, PART):
                        a = np.arange(first, min(first + PART, i))
                        yield a, np.full(len(a), i)
                i = j

        def possible(a, b):
            ok = (before[a] != before[b]) | (before[a] == 0)
            if split:
                ok &= (side[a] != side[b]) | (side[a] == 0)
            a, b = a[ok], b[ok]
            needed = (size[a] + size[b]) * (threshold / (1.0 + threshold)) - EPS
            ok = np.minimum(at[a], at[b]) + np.minimum(size[a] - at[a], size[b] - at[b]) >= needed
            ea, eb, needed = entry[a[ok]], entry[b[ok]], needed[ok]
            ok = (ea != eb) & (probe[ea] | probe[eb])
            long = np.flatnonzero(ok & (np.minimum(sketches.bits[ea], sketches.bits[eb]) > SHORT_BITS))
            ok[long] = m[ea[long]] + m[eb[long]] - sketches.differ(ea[long], eb[long]) >= 2 * needed[long]
            return np.unique(ea[ok] << 32 | eb[ok])

        def made(found):
            once = np.unique(np.concatenate(found))
            ea, eb = once >> 32, once & 0xFFFFFFFF
            xor = short[ea] ^ short[eb]
            arrays = [gid[ea], gid[eb], *[x.astype(np.int32) for x in (n[ea], n[eb], m[ea] + m[eb])], *[np.ascontiguousarray(xor[:, k]).view(np.int64) for k in range(SHORT)]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)
        found, waiting = [], 0
        for a, b in parts():
            found.append(possible(a, b))
            waiting += len(found[-1])
            if waiting >= OUT:
                yield made(found)
                found, waiting = [], 0
        if waiting:
            yield made(found)
    return run


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An ``applyInArrow`` function from rows ``(bucket, ka, kb, text)``, pairs and
    (where kb is null) the words of sets, to ``(ka, kb, na, nb, inter)``."""
    table = pa.Table.from_batches(list(batches))
    alone = table.column("kb").is_null()
    texts, pairs = table.filter(alone), table.filter(pc.invert(alone))
    words = pc.split_pattern(texts.column("text").combine_chunks(), " ")
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    number = pc.dictionary_encode(words.flatten()).indices.to_numpy(zero_copy_only=False)
    begins = np.concatenate(([0], np.cumsum(size)))
    ids = texts.column("ka").to_numpy()
    order = np.argsort(ids)
    ka, kb = pairs.column("ka").to_numpy(), pairs.column("kb").to_numpy()
    a, b = (order[np.searchsorted(ids[order], x)] for x in (ka, kb))
    turn = np.argsort(a, kind="stable")
    a, b = a[turn], b[turn]
    inter = np.zeros(len(a), np.int64)
    held = np.zeros(int(number.max(initial=0)) + 1, bool)
    cuts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.empty(0, np.int64)
    for i, j in zip(cuts, np.append(cuts[1:], len(a)), strict=True):
        own = number[begins[a[i]]: begins[a[i] + 1]]
        held[own] = True
        for k in range(i, j, 1 << 10):
            some = b[k: min(j, k + (1 << 10))]
            hits = held[number[np.repeat(begins[some], size[some]) + _spread(size[some])]]
            inter[k: k + len(some)] = np.add.reduceat(hits, np.cumsum(size[some]) - size[some], dtype=np.int64)
        held[own] = False
    out = pa.table({"ka": ka[turn], "kb": kb[turn], "na": size[a], "nb": size[b], "inter": inter})
    yield from out.to_batches(max_chunksize=OUT)

"""Operator 11, BPE encoding and decoding by tree concatenation.

A text longer than a leaf is halved until every piece is a leaf.  Leaves are
encoded in parallel, whichever executor holds them, and joined pairwise, level
by level.  Around each join a window of tokens is encoded anew, one token on
either side, then two, four and so on, until its first and its last token are
those that stood there before; what lies outside stays as it is.

Why that is exact.  The vocabulary drops white space and never merges across
words, and all its merges are made of earlier ones.  A sequence of tokens is
then the encoding of its text if each two neighbours are: the first merge
across a border would need the same two symbols at the same time in the
neighbours alone.  Neighbours inside the window were encoded together, a
border of the window lies between two tokens that were neighbours before.  A
window may also end at its word's border, where nothing merges.

Where a text may be cut (``seam``): beside white space or an ASCII digit, which
no word crosses, or between two letters or two punctuation marks of one word,
the case that joins repair.  Not inside a special token, not near an
apostrophe (``'s`` is a word of its own), not before or after characters that
composition or lower-casing could change across the cut.  A stretch without
any such place (only combining marks, say) stays one leaf.

The words between white space are encoded by the tokenizers library, each once
for as long as it is remembered (``WORDS`` of them in a worker).

Defined cases: null and empty texts have no ids; rows stay one row each, also
repeated rows and null ids; ids may have any type; very long texts are cut, so
that no task encodes more than a leaf at a time, and the ids of one document
are one row, as its text is; ties do not arise; further columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a leaf.
LEAF = 16_384
#: Words that a worker remembers.
WORDS = 400_000
#: Tokens gathered before an output batch is handed to Spark.
OUT_TOKENS = 1_000_000

_SPACE = frozenset(" \t\n\r\x0b\x0c")
_DIGIT = frozenset("0123456789")
_MARK = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def _letter(c: str) -> bool:
    """A letter that neither composition nor lower-casing turns into anything
    but one letter, and that does not compose with what stands before it."""
    if c.isascii():
        return c.isalpha()
    low, _old = c.lower(), unicodedata.ucd_3_2_0    # letters since then are letters to every library
    return (_old.category(c)[0] == "L" and len(low) == 1 and _old.category(low)[0] == "L"
            and unicodedata.normalize("NFC", c) == c and not 0x1100 <= ord(c) <= 0x11FF)


class Vocabulary:
    """A vocabulary file of the tokenizers library with ends of words."""

    def __init__(self, path: str | None = None):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one thread for each task
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel
        path = path or public_tokenizers.path("word_bpe_49k.json")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not self.suffix or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("tree concatenation needs a BPE vocabulary with ends of words, no post-processor and no decoder")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = BPE(vocab=model["vocab"], merges=merges)       # for text that its word goes on behind
        self.last = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)
        self.tokens = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.special_ids = {t["id"] for t in spec.get("added_tokens", ())}
        self.closing = np.array([t.endswith(self.suffix) or i in self.special_ids for i, t in enumerate(self.tokens)])
        # Plain words: printable ASCII without apostrophe, and letters up to U+017F that are
        # letters in lower case too; these are written as the library writes their bytes.
        letters = [chr(c) for c in range(0xC0, 0x180) if _letter(chr(c))]
        lower = "".join(sorted({c.lower() for c in letters}))
        self.plain = re.compile("[!-&(-~" + "".join(letters) + "]+")
        self.parts = re.compile(f"[a-z{lower}]+|[0-9]|[^a-z0-9{lower}]+")
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in lower}
        self.known: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.flat, self.starts = array("i"), array("q", [0])

    def _found(self, words: list[bytes]):
        """(word, ids) of each word.  A plain word is a letter run, a digit or
        a run of marks after the other, which the model alone encodes."""
        rest, raw = [], []
        for word in words:
            text = word.decode()
            if self.plain.fullmatch(text) and not any(s in text for s in self.specials):
                parts = self.parts.findall(text.lower())
                yield word, [t.id for part in parts for t in self.last.tokenize(part if part.isascii() else part.translate(self.written))]
            else:
                rest.append(text)
                raw.append(word)
        if rest:
            for word, found in zip(raw, self.library.encode_batch(rest, add_special_tokens=False), strict=True):
                yield word, found.ids

    def _learn(self, words: list[bytes]) -> None:
        for word, ids in self._found(words):
            self.known[word] = len(self.known)
            self.flat.extend(ids)
            self.starts.append(len(self.flat))

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a whole text, white space on both its sides."""
        words = text.split()
        if not words:
            return np.empty(0, np.int32)
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            if len(self.known) + len(new) > WORDS:
                self._forget()
                new = list(dict.fromkeys(words))
            self._learn(new)
        flat, starts = np.frombuffer(self.flat, np.int32), np.frombuffer(self.starts, np.int64)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = starts[at + 1] - starts[at]
        place = np.arange(int(size.sum())) + np.repeat(starts[at] - (np.cumsum(size) - size), size)
        return flat[place]

    def _ids(self, model, symbols: str) -> np.ndarray:
        return np.array([t.id for t in model.tokenize(symbols)], np.int32)

    def encode_leaf(self, text: bytes, goes_on: bool) -> np.ndarray:
        """The ids of a piece; with ``goes_on`` its last word does not end here."""
        ids = self.encode(text)
        if not goes_on or not len(ids):
            return ids
        tail = self._tail(ids[:-1]) + 1
        symbols = "".join(map(self.tokens.__getitem__, ids[-tail:].tolist()))[: -len(self.suffix)]
        return np.concatenate((ids[:-tail], self._ids(self.inner, symbols)))

    def _tail(self, ids: np.ndarray) -> int:
        """Tokens behind the last end of a word."""
        step = 64
        while step < len(ids):
            ends = np.flatnonzero(self.closing[ids[-step:]])
            if len(ends):
                return step - 1 - int(ends[-1])
            step *= 8
        ends = np.flatnonzero(self.closing[ids])
        return len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids)

    def _head(self, ids: np.ndarray) -> tuple[int, bool]:
        """Tokens up to the first end of a word, and whether there is one."""
        step = 64
        while True:
            ends = np.flatnonzero(self.closing[ids[:step]])
            if len(ends):
                return int(ends[0]) + 1, True
            if step >= len(ids):
                return len(ids), False
            step *= 8

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of two neighbouring pieces together."""
        if not len(a) or not len(b) or self.closing[a[-1]]:
            return np.concatenate((a, b))
        tail = self._tail(a)
        head, closed = self._head(b)
        k = 1
        while True:
            left, right = a[len(a) - min(k, tail):], b[:min(k, head)]
            symbols = "".join(map(self.tokens.__getitem__, np.concatenate((left, right)).tolist()))
            if closed and k >= head:
                new = self._ids(self.last, symbols[: -len(self.suffix)])
            else:
                new = self._ids(self.inner, symbols)
            if (k >= tail or new[0] == left[0]) and (k >= head or new[-1] == right[-1]):
                return np.concatenate((a[: len(a) - len(left)], new, b[len(right):]))
            k *= 2

    def seam(self, text: str, p: int) -> str | None:
        """``apart`` if no word crosses place ``p``, ``within`` if one does and
        a join can repair it, None if the text may not be cut there."""
        a, b = text[p - 1], text[p]
        for s in self.specials:
            i = text.find(s, max(0, p - len(s) + 1), p + len(s) - 1)
            if i != -1 and i < p < i + len(s):
                return None
            if text.startswith(s, p) or text.endswith(s, 0, p):
                return "apart"
        if a in _SPACE or b in _SPACE:
            return "apart"
        if "'" in text[max(0, p - 4): p + 4]:
            return None
        if (a in _DIGIT or b in _DIGIT) and all(c in _DIGIT or c in _MARK or _letter(c) for c in (a, b)):
            return "apart"
        if (a in _MARK and b in _MARK) or (_letter(a) and _letter(b)):
            return "within"
        return None

    def cut(self, text: str, leaf: int) -> list[tuple[int, int, bool]]:
        """Leaves (start, end, whether a word goes on behind) by halving."""
        out, todo = [], [(0, len(text), False)]
        while todo:
            lo, hi, goes_on = todo.pop()
            how = None
            if hi - lo > leaf:
                p = (lo + hi) // 2
                while p < hi and (how := self.seam(text, p)) is None:
                    p += 1
            if how is None:
                out.append((lo, hi, goes_on))
            else:
                todo += [(p, hi, goes_on), (lo, p, how == "within")]
        return out

    def fold(self, leaves: list[np.ndarray]) -> np.ndarray:
        """All leaves of a text joined as a tree."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i: i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]


def vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of this process: it is kept with the library, which stays
    loaded, as every task gets this module anew."""
    import tokenizers
    kept = tokenizers.__dict__.setdefault("_memlake_vocabularies", {})
    if path not in kept:
        kept[path] = Vocabulary(path)
    return kept[path]


class _Rows:
    """Output rows: some columns as they came, and a list of ids."""

    def __init__(self):
        self.kept, self.ids, self.n = [], [], 0

    def add(self, kept: tuple, ids: np.ndarray) -> None:
        self.kept.append(kept)
        self.ids.append(ids)
        self.n += len(ids) + 16

    def take(self, fields: list[pa.Field]):
        if not self.kept:
            return
        ends = np.cumsum([0] + [len(i) for i in self.ids])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(self.ids), pa.int32()))
        columns = [pa.array([r[j] for r in self.kept], f.type) for j, f in enumerate(fields)]
        self.__init__()
        yield pa.RecordBatch.from_arrays([*columns, lists], names=[*(f.name for f in fields), "ids"])


def _raw(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _whole(path):
    def run(batches):
        v, rows, fields = vocabulary(path), _Rows(), None
        for batch in batches:
            fields = [batch.schema.field("doc_id")]
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                rows.add((doc_id.as_py(),), v.encode(_raw(text)))
                if rows.n >= OUT_TOKENS:
                    yield from rows.take(fields)
        yield from rows.take(fields)
    return run


def _cut(path, leaf):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for i in range(batch.num_rows):
                row, doc_id, text = batch.column("row")[i].as_py(), batch.column("doc_id").slice(i, 1), batch.column("text")[i].as_py()
                places = v.cut(text, leaf)
                for s in range(0, len(places), 256):
                    some = places[s: s + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.concat_arrays([doc_id] * len(some)),
                         pa.array(range(s, s + len(some)), pa.int32()), pa.array([g for _, _, g in some], pa.bool_()),
                         pa.array([text[a:b] for a, b, _ in some], pa.string())],
                        names=["row", "doc_id", "part", "goes_on", "text"])
    return run


def _leaves(path):
    def run(batches):
        v, rows, fields = vocabulary(path), _Rows(), None
        for batch in batches:
            fields = [batch.schema.field(c) for c in ("row", "doc_id", "part")]
            for row, doc_id, part, goes_on, text in zip(*(batch.column(c) for c in ("row", "doc_id", "part", "goes_on", "text")), strict=True):
                rows.add((row.as_py(), doc_id.as_py(), part.as_py()), v.encode_leaf(_raw(text), goes_on.as_py()))
                if rows.n >= OUT_TOKENS:
                    yield from rows.take(fields)
        yield from rows.take(fields)
    return run


def _joined(path):
    """Leaves in the order of (row, part) to whole texts."""
    def run(batches):
        v, rows, fields, held, row_now = vocabulary(path), _Rows(), None, [], None
        for batch in batches:
            fields = [batch.schema.field("doc_id")]
            lists = batch.column("ids")
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (row, doc_id) in enumerate(zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                if row != row_now:
                    if held:
                        rows.add((doc_now,), v.fold(held))
                        if rows.n >= OUT_TOKENS:
                            yield from rows.take(fields)
                    held, row_now, doc_now = [], row, doc_id
                held.append(values[offsets[i]: offsets[i + 1]].astype(np.int32))
        if held:
            rows.add((doc_now,), v.fold(held))
        yield from rows.take(fields)
    return run


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ids (array of int)."""
    docs = id_text(docs, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = docs.where(~is_long).mapInArrow(_whole(path), f"doc_id {id_type}, ids array<int>")
    # A row's number tells repeated rows apart; the scan gives the same ones when a task is run again.
    pieces = docs.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        _cut(path, leaf), f"row long, doc_id {id_type}, part int, goes_on boolean, text string")
    leaves = pieces.repartition("row", "part").mapInArrow(_leaves(path), f"row long, doc_id {id_type}, part int, ids array<int>")
    long = leaves.repartition("row").sortWithinPartitions("row", "part").mapInArrow(_joined(path), f"doc_id {id_type}, ids array<int>")
    return short.unionByName(long)


def decoded(ids, path: str | None = None):
    """Column: the text of a column of ids, as the library decodes them with
    special tokens (tokens joined by one space; ids out of range are skipped)."""
    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        import pyarrow.compute as pc
        tokens = pa.array(vocabulary(path).tokens, pa.string())
        out, values, ends = [], lists.values, lists.offsets.to_numpy()
        at = 0
        while at < len(lists):      # some rows at a time, as 32-bit places must do for their text
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + OUT_TOKENS, "right")) - 1)
            ids = values.slice(ends[at], ends[to] - ends[at])
            places = ends[at: to + 1] - ends[at]
            known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(tokens))).to_numpy(zero_copy_only=False)
            if not known.all():
                places, ids = np.concatenate(([0], np.cumsum(known)))[places], ids.filter(pa.array(known))
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), tokens.take(ids)), " "))
            at = to
        return pa.concat_arrays(out) if out else pa.array([], pa.string())
    return run(ids)

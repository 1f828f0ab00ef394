import zlib

import numpy as np
from pyspark.sql import functions as F

from memlake.llm import language_id, toxicity
from memlake.llm.packing import END_ID, OpenWindows, _encoder, pack

from .helpers import awkward, frame, prose


def encoded(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    if not hasattr(encoded, "with_file"):
        encoded.with_file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.with_file.encode(text or "", add_special_tokens=False).ids


def test_packing_is_an_exact_partition(spark):
    rows = awkward() + [(i, prose(i, i % 90)) for i in range(100, 400)] + [(500, "<|endoftext|> x <| y"), (501, "日本 Ω"), (502, "x " * 2047)]
    pieces = pack(frame(spark, rows).repartition(3)).collect()
    tokens = {i: [*encoded(t), END_ID] for i, t in rows}
    ids = sorted({i for i, _ in rows if i is not None})
    for i in ids:
        own = sorted({(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces if p.doc_id == i})
        at = 0
        for start, length, crc, total in own:
            assert start == at and total == len(tokens[i])
            assert crc == zlib.crc32(np.array(tokens[i][start:start + length], "<u4").tobytes())
            at += length
        assert at == len(tokens[i])
    assert sum(p.length for p in pieces) == sum(len([*encoded(t), END_ID]) for _, t in rows)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(p.length for p in pieces)
    assert len(sequences) * 1024 - used < 0.1 * used
    assert pack(frame(spark, rows).limit(0)).collect() == []


def test_tightest_open_window():
    chance = np.random.default_rng(1)
    windows, left = OpenWindows(64), []
    for length in sorted(chance.integers(1, 65, 500).tolist(), reverse=True):
        place, offset = windows.fit(length)
        fitting = [r for r in left if r >= length]
        if fitting:
            assert left[place] == min(fitting) and offset == 64 - left[place]
            left[place] -= length
        else:
            assert place == len(left) and offset == 0
            left.append(64 - length)


def test_both_encoders_agree():
    encode, chance = _encoder(None, None), np.random.default_rng(4)
    for _ in range(3000):
        points = chance.choice([*range(0x240), *[32, 10, 39, 0xA0, 0x85] * 20, 0x4E2D, 0x1F600], size=chance.integers(0, 25))
        text = "".join(map(chr, points))
        assert encode(np.frombuffer(text.encode(), np.uint8)).tolist() == encoded(text)


def languages(n: int = 60):
    chance = np.random.default_rng(2)
    stems = {"aa": ["tion", "ing", "the"], "bb": ["keit", "der", "schön"], "cc": ["мир", "дом", "лес"]}
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(chance.choice(stems[lang], 2)) for _ in range(chance.integers(5, 60))), lang))
    return rows


def test_language_held_out_accuracy_and_awkward_rows(spark):
    rows = languages()
    extra = [(i + 1000 if i else None, t) for i, t in awkward()] + [(2000, "123 456 !?"), (2001, rows[0][1], None)]
    docs = frame(spark, rows + extra)
    got = language_id.identify(docs, F.col("doc_id") < 30, per_language=8).collect()
    assert len(got) == len(rows) + len(extra)
    found = {r.doc_id: r for r in got}
    assert all(found[i].lang_pred == lang for i, _, lang in rows)
    for i in (1001, 1002, 1003, 2000):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, False)
    assert all(0 <= r.score <= 1 for r in got) and found[2001].lang_pred == "aa"
    assert found[1009].rejected                           # 500 times one letter is like none of them
    none = language_id.identify(docs, F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(docs.limit(0), F.lit(True)).collect() == []


def test_every_language_is_learned(spark):
    """More than 64 languages, each of letters of its own."""
    rows = [(10 * k + i, " ".join(chr(0x4E00 + 20 * k + (7 * i + j * j) % 5) * 2 for j in range(30)), f"l{k:02}") for k in range(70) for i in range(6)]
    docs = frame(spark, rows)
    for fitting in ({}, {"most_rows": 70, "least_rows": 2}):
        found = {r.doc_id: r.lang_pred for r in language_id.identify(docs, F.lit(True), **fitting).collect()}
        assert found == {i: lang for i, _, lang in rows}


def test_every_letter_counts():
    letters = language_id._letter_table()
    assert all((letters[c] != 32) == chr(c).isalpha() for c in range(0x110000))
    for letter in ("\U0001E900", "\U0001D400", "\U0001B000", "\U0001B170"):
        assert language_id.counts(np.frombuffer(letter.encode(), np.uint8)) is not None


def test_toxicity_held_out_and_awkward_rows(spark):
    chance, bad = np.random.default_rng(6), ["vilest", "rotten", "grubby"]
    rows, labels = [], []
    for i in range(400):
        words = prose(i, int(chance.integers(8, 60)), 300).split()
        toxic = int(i % 4 == 0)
        for _ in range(toxic * 3):
            words.insert(int(chance.integers(len(words))), str(chance.choice(bad)))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = frame(spark, rows + [(i + 1000 if i else None, t) for i, t in awkward()])
    table = spark.createDataFrame([x for x in labels if x[0] < 250] + [(None, 1), (3, None), (9999, 1)], "doc_id long, label int")
    machine = toxicity.fit(docs.select("doc_id", "text"), table)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    found = {r.doc_id: r.predicted for r in got}
    assert np.mean([found[i] == y for i, y in labels if i >= 250]) > 0.97
    assert found[1001] == found[1002] == 0
    kept = toxicity.without_toxic(docs, machine)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    none = toxicity.fit(docs.select("doc_id", "text"), table.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), machine).collect() == []


def test_pairs_weigh_more_than_both_alone():
    """Only texts with both terms are of label 1: no additive weights tell them apart as clearly."""
    a, b, chance = np.array([5]), np.array([9]), np.random.default_rng(0)
    rows = []
    for i in range(800):
        noise = chance.integers(100, 140, 6)
        rows.append((int(i % 4 == 3), np.unique(np.concatenate([noise, *([a] if i % 4 in (1, 3) else []), *([b] if i % 4 in (2, 3) else [])]))))
    machine = toxicity.Machine(rows, least_chi=5, rounds=60)
    i, j = machine.slot[5], machine.slot[9]
    assert machine.v[i] @ machine.v[j] > 0
    assert machine.score(np.array([5, 9])) > 0.7 > 0.5 > max(machine.score(a), machine.score(b))


def test_packing_does_not_depend_on_splits(spark):
    rows = [(i % 700, prose(i % 900, 5 + i * 37 % 400)) for i in range(1500)]
    windows = []
    for splits in (2, 60):
        pieces = pack(frame(spark, rows).repartition(splits), group=400).collect()
        assert len(pieces) >= len(rows)
        held = {}
        for p in pieces:
            held.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for placed in held.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= 1024
        windows.append(len(held))
        assert len(held) * 1024 <= 1.03 * sum(p.length for p in pieces)
    assert abs(windows[0] - windows[1]) <= 0.01 * windows[0]

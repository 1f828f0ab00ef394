import hashlib
import random

import numpy as np
import pytest

from memlake.llm import minhash_dedup as M
from memlake.llm import windows as W
from memlake.llm.components import components
from memlake.llm.substring_dedup import substring_dedup
from memlake.llm.suffix_dedup import suffix_dedup

from .helpers import awkward, frame, prose, removed_bytes, removed_words


def shared_passages(seed: int) -> list[tuple]:
    """Texts that share passages at varying places, many of one hot passage."""
    chance = random.Random(seed)
    hot, parts = prose(100, 70), [prose(200 + k, chance.randrange(40, 140)) for k in range(8)]
    rows = []
    for i in range(60):
        text = [prose(1000 + seed * 100 + i, chance.randrange(0, 60))]
        if i % 3 == 0:
            text.append(hot)
        if i % 2:
            text.append(" ".join(chance.choice(parts).split()[chance.randrange(20):]))
        text.append(prose(5000 + seed * 100 + i, chance.randrange(0, 40)))
        rows.append((i, chance.choice([" ", "\n", "  "]).join(text)))
    return rows


@pytest.mark.parametrize("rows", [awkward()[:-1], shared_passages(1), shared_passages(2)], ids=["awkward", "passages1", "passages2"])
def test_substring_dedup_matches_brute_force(spark, rows):
    got = {}
    for r in substring_dedup(frame(spark, rows)).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        if r.doc_id is not None:
            got[r.doc_id] = (r.n_words, r.n_removed, r.kept_sha256)
        else:
            assert r.n_removed == 0
    assert got == removed_words(rows)


def test_substring_dedup_of_other_lengths_and_nothing(spark):
    rows = shared_passages(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, rows), length=7).collect()}
    assert got == removed_words(rows, 7)
    assert substring_dedup(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("rows", [awkward(), shared_passages(1), shared_passages(4)], ids=["awkward", "passages1", "passages4"])
def test_suffix_dedup_matches_brute_force(spark, rows):
    got = sorted(((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted(removed_bytes(rows), key=str)


def test_suffix_dedup_overlaps_and_single_edits(spark):
    base = prose(7, 200)
    rows = [(1, "ab" * 400), (2, base), (3, base[:300] + "#" + base[301:]), (4, "x" * 199), (5, "x" * 199 + "y"), (6, "z" * 201), (7, base[150:349])]
    got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup(frame(spark, rows)).collect())
    assert got == removed_bytes(rows)
    assert suffix_dedup(frame(spark, rows).limit(0)).collect() == []


def test_anchors_depend_on_the_window_alone():
    chance = np.random.default_rng(1)
    text = chance.integers(0, 3, 500).astype(np.uint64)
    grams = W.gram_names(text, 6)
    at, lo, hi = W.anchors(grams, 15)
    assert lo[0] == 0 and hi[-1] == len(grams) - 15 and (lo[1:] == hi[:-1] + 1).all()
    for a, first, last in zip(at, lo, hi, strict=True):
        for s in range(first, last + 1):
            low = (grams[s:s + 15] >> np.uint64(24)).tolist()
            assert a == s + low.index(min(low))


def near_rows() -> list[tuple]:
    chance, rows = random.Random(5), []
    for g in range(12):
        base = prose(g, 150, 3000).split()
        rows.append((len(rows), " ".join(base)))
        for k in range(chance.choice([0, 1, 2, 25])):
            text = list(base)
            for _ in range(chance.randrange(0, 3)):
                text[chance.randrange(len(text))] = f"edit{g}x{k}x{chance.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(text) if k % 4 else "  ".join(text).upper()))
    return rows + [(i + 1000, t) for i, t in awkward() if i is not None]


def brute_classes(rows) -> dict:
    docs = {i: np.frombuffer((t or "").encode(), np.uint8) for i, t in rows}
    bag = {i: M.shingles(M.word_names(t)) for i, t in docs.items()}
    df = np.zeros(1 << M.CLASS_BITS)
    for i, t in rows:
        if t is not None:
            np.add.at(df, M._class(bag[i][0]), 1)
    n = sum(t is not None for _, t in rows)
    weights = (1 + np.maximum(np.log((1 + n) / (1 + df)), 0) / (4 * np.log(2 + n))).astype(np.float32)
    label = {i: i for i in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(docs)
    for x in ids:
        for y in ids:
            if x < y and M.weighted_jaccard(docs[x], docs[y], weights) >= 0.8:
                a, b = sorted((root(x), root(y)))
                label[b] = a
    return {i: root(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    got = M.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == brute_classes(list(dict(rows).items()))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_pairs_in_a_crowd_of_one_template(spark):
    """Thousands of texts at 0.7, with pairs above 0.8 that share a few words of their own."""
    template, rows, pairs = prose(50, 104, 3000), [], []
    for i in range(2400):
        rows.append((i, f"{template} " + " ".join(f"own{i}x{k}" for k in range(17))))
    for i in range(3000, 3240, 2):
        pairs.append((i, i + 1))
        for j in pairs[-1]:
            rows.append((j, f"{template} " + " ".join([*(f"both{i}x{k}" for k in range(8)), *(f"own{j}x{k}" for k in range(9))])))
    texts = {i: np.frombuffer(t.encode(), np.uint8) for i, t in rows}
    df = np.zeros(1 << M.CLASS_BITS)
    for t in texts.values():
        np.add.at(df, M._class(M.shingles(M.word_names(t))[0]), 1)
    weights = (1 + np.maximum(np.log((1 + len(rows)) / (1 + df)), 0) / (4 * np.log(2 + len(rows)))).astype(np.float32)
    assert all(M.weighted_jaccard(texts[a], texts[b], weights) > 0.81 for a, b in pairs)
    assert all(0.68 < M.weighted_jaccard(texts[0], texts[i], weights) < 0.75 for i, _ in rows[1:])
    got = {r.doc_id: r.class_id for r in M.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows} | {b: a for a, b in pairs}


def test_near_pairs_of_words_that_a_crowd_shares(spark, monkeypatch):
    """Near texts are of the same three passages in another order; each passage has more holders than are all paired."""
    monkeypatch.setattr(M, "BLOCK", 64)
    chance, template = random.Random(9), prose(60, 120, 3000)
    own = [prose(700 + k, 17, 3000) for k in range(12)]
    rows = [(i, f"{template} " + f" {i}x ".join(chance.sample(own, 3))) for i in range(120)]
    got = {r.doc_id: r.class_id for r in M.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("block", [3, 512])
def test_every_pair_of_a_bucket_is_met(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = near_rows()
    rows = [(i, t) for i, t in dict(rows).items() if t and M.word_names(np.frombuffer(t.encode(), np.uint8)).size]
    docs = frame(spark, rows)
    table = spark.sparkContext.broadcast(M.weights_table(docs))
    texts = {i: np.frombuffer(t.encode(), np.uint8) for i, t in rows}
    comps = {i: i % 7 for i in texts}
    crowds = spark.createDataFrame([(5, i, comps[i]) for i in texts] + [(6, i, 1) for i in texts], "key long, doc_id long, comp long")
    wanted = {(a, b): M.weighted_jaccard(texts[a], texts[b], table.value) for a in texts for b in texts if a < b and comps[a] != comps[b]}
    got = {(r.a, r.b): r.similarity for r in M._every_pair(crowds, docs, table, 0.8).collect()}
    assert got == {p: v for p, v in wanted.items() if v >= 0.8} and got


def test_near_duplicates_of_null_ids_and_nothing(spark):
    text = prose(1, 50)
    got = M.near_duplicates(frame(spark, [(None, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (2, 1, False)]
    assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert M.near_duplicates(frame(spark, [(1, text)]).limit(0)).collect() == []


def test_samples_estimate_weighted_jaccard():
    chance = np.random.default_rng(3)
    names = chance.integers(1 << 62, size=400).astype(np.uint64) * np.uint64(3)
    names.sort()
    one, other = chance.random(400) + 0.2, chance.random(400) + 0.2
    other[:250] = one[:250]
    sampler = M.Sampler()
    agree = 0
    for seed in range(12):
        turned = np.sort(W.mix(names + np.uint64(seed)))
        agree += (sampler.sample(turned, one) == sampler.sample(turned, other)).mean() / 12
    truth = np.minimum(one, other).sum() / np.maximum(one, other).sum()
    assert abs(agree - truth) < 0.08


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(links, "test").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 105: 100}

import collections
import hashlib
import random
import zlib

import pytest

from memlake.llm import bpe, collocations, merkle

from .helpers import FOLD, awkward, frame, prose

SCRAPS = ["abcdefgh", "thing ", "the", "'s", "'re", "'", " ", "  ", "\n", "\x0b", "\x0c", " ", "é", "é", "İ", "ſ",
          "中文", "한", "ᄒ", "ᅡ", "ᆫ", "123", "²", "!!", "--", "<|endoftext|>", "<|", "Σ", "ß",
          "\U0001f642", "‍", "क़", "क़", "aaaaaaa", "ing", "ll"]


def library_ids(text):
    return bpe.vocabulary().library.encode(text, add_special_tokens=False).ids


def tree_ids(text, leaf):
    v = bpe.vocabulary()
    leaves = v.cut(text, leaf)
    assert "".join(text[a:b] for a, b, _ in leaves) == text
    return v.fold([v.encode_leaf(text[a:b].encode(), goes_on) for a, b, goes_on in leaves]).tolist()


def test_tree_concatenation_is_exact():
    chance = random.Random(11)
    for _ in range(800):
        text = "".join(chance.choice(SCRAPS) for _ in range(chance.randrange(1, 50)))
        assert tree_ids(text, chance.choice([2, 3, 5, 9])) == library_ids(text), text
    for i in range(30):
        text = chance.choice("aeo!") * 2000 if i % 3 == 0 else "".join(chance.choice("abcdeiorstnghl") for _ in range(2000))
        assert tree_ids(text, 37) == library_ids(text)


def test_merges_are_made_of_earlier_ones():
    import json

    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    made = {}
    for a, b in model["merges"]:
        assert all(x in made or len(x.replace("</w>", "")) == 1 for x in (a, b)) and a + b not in made
        made[a + b] = True


def test_encoding_and_decoding_on_tables(spark):
    rows = awkward() + [(40, "<|endoftext|>Don't é ſo!"), (41, "antidisestablishment" * 300)]
    for leaf in (64, 16_384):
        coded = bpe.encode(frame(spark, rows), leaf=leaf)
        got = coded.select("doc_id", "ids", bpe.decoded(coded["ids"]).alias("text")).collect()
        want = [(i, ids, bpe.vocabulary().library.decode(ids, skip_special_tokens=False)) for i, ids in ((i, library_ids(t or "")) for i, t in rows)]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode(frame(spark, rows).limit(0)).collect() == []
    named = frame(spark, rows).withColumnRenamed("doc_id", "name").selectExpr("cast(name as string) as name", "text")
    assert sorted(map(str, (r.ids for r in bpe.encode(named, leaf=64, id_col="name").collect()))) == sorted(str(library_ids(t or "")) for _, t in rows)


def test_vocabularies_without_ends_of_words_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


# ------------------------------------------------------------------ manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes, fanout=8):
    """(root, proof siblings of each node as (before, behind) by level)"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = nodes[at[k] // fanout * fanout:][:fanout]
            path.append(("".join(run[:at[k] % fanout]), "".join(run[at[k] % fanout + 1:])))
            at[k] //= fanout
        nodes = [H(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute_manifest(rows):
    by_lang = collections.defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: climb([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])]) for lang in langs}
    root, over = climb([trees[lang][0] for lang in langs])
    out = []
    for lang, up in zip(langs, over, strict=True):
        for (_, _, h, r), path in zip(sorted(by_lang[lang], key=lambda x: x[:3]), trees[lang][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            fold = leaf(r, r[4].translate(FOLD)) if tampered else h
            for before, behind in path + up:
                fold = H(before, fold, behind)
            out.append((r[0], h, trees[lang][0], root, H(*(a + b for a, b in path + up)), fold, fold == root))
    return out


def manifest_rows():
    rows = [(i, f"src{i % 3}", "en", i, f"Text {i} É") for i in range(70)] + [(i, None, "fr", None, f"plain {i}") for i in range(100, 109)]
    rows += [(200, "s", None, 1, None), (201, "s", "de", 1, ""), (202, "s", "", 5, "x" * 100_000), (203, "s", "é", 1, "Z"), (203, "s", "é", 1, "Z")]
    return rows + [(None, "s", "en", 3, "No id"), (None, "s", "en", 3, "No id"), (5, "src5", "en", 9, "Same id")]


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, digest string, pos string, scope string"


@pytest.mark.parametrize("rows", [manifest_rows(), manifest_rows()[:1], manifest_rows()[:8], []])
def test_manifest_matches_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "d", None, "s") for r in rows], MANIFEST)
    got = merkle.manifest(docs, merkle.lower_case_tampering(docs)).drop("path").collect()
    want = brute_manifest(rows) if rows else []
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert not rows or {r.verified for r in got} == ({True, False} if len(rows) > 8 else {r[6] for r in want})


def test_positions_hold_whatever_the_partitions(spark):
    nodes = spark.range(0, 3000, numPartitions=7).selectExpr("if(id % 3 = 0, 'b', 'a') as scope", "(id * 7919) % 1000 as k", "id")
    got = merkle.positions(nodes, "scope", ["k", "id"], "test").collect()
    for scope in "ab":
        rows = sorted((r.k, r.id) for r in got if r.scope == scope)
        assert [(r.k, r.id) for r in sorted((r for r in got if r.scope == scope), key=lambda r: r.pos)] == rows
        assert {r.n for r in got if r.scope == scope} == {len(rows)}
        assert sorted(r.pos for r in got if r.scope == scope) == list(range(len(rows)))


# -------------------------------------------------------------- collocations

def brute_collocations(rows, least, top, cover=80):
    import re
    count, size = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            count.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    many = {p: c for p, c in count.items() if len(p[1]) > 1 and c >= least}
    hidden = set()
    for (lang, w), c in many.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * c >= cover * many[lang, w[i:i + k]]:
                    hidden.add((lang, w[i:i + k]))
    out = collections.defaultdict(list)
    for (lang, w), a in many.items():
        if (lang, w) not in hidden:
            score, k = min((2_000_000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return [(lang, i + 1, p.decode(), -a, x, y, size[lang], -score)
            for lang, found in out.items() for i, (score, a, p, x, y) in enumerate(sorted(found)[:top])]


def phrase_rows():
    chance = random.Random(4)
    vocabulary = ["New", "York", "city", "of", "the", "À", "é", "x", "x", "über-all", "日本", "a b", "end"]
    rows = [(i, "".join(chance.choice(vocabulary) + chance.choice([" ", " ", "\t ", " ", ", ", ".", "\n", "\x0b"]) for _ in range(chance.randrange(60))),
             chance.choice(["en", "fr", None, "und"])) for i in range(300)]
    return rows + [(None, "New York city of the end " * 50, "en"), (7, None, "en"), (8, "", None), (9, "the the the the the " * 400, "xx"), (9, "one", "yy")]


@pytest.mark.parametrize("block", [collocations.BLOCK, 97])
def test_collocations_match_brute_force(spark, block):
    rows = phrase_rows()
    got = collocations.collocations(frame(spark, rows), least=20, top=40, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(brute_collocations(rows, 20, 40))
    assert len(got) > 30


def test_collocations_of_nothing_and_of_other_shards(spark):
    rows = phrase_rows()
    assert collocations.collocations(frame(spark, rows).limit(0)).collect() == []
    few = [tuple(r) for r in collocations.collocations(frame(spark, rows), least=30, top=2000, shards=3).collect()]
    assert sorted(few) == sorted(brute_collocations(rows, 30, 2000))


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    phrases = spark.createDataFrame([("en", 0, "", 10 * big), ("en", 1, "a", 2 * big), ("en", 1, "b", big + 1), ("en", 2, "a b", big)],
                                    "lang string, k int, phrase string, c long")
    assert [tuple(r) for r in collocations.score_phrases(phrases).collect()] == [
        ("en", "a b", big, 2 * big, big + 1, 2_000_000 * big // (3 * big + 1), 10 * big)]


def test_words_longer_than_a_stretch(spark):
    word = "w" * (collocations.STRETCH * 2 + 5)
    rows = [(1, f"{word} b c " * 3, "en"), (2, f"c {word} b", "en")]
    got = collocations.collocations(frame(spark, rows), least=3, block=1000).collect()
    assert sorted(map(tuple, got)) == sorted(brute_collocations(rows, 3, 2000))


def test_short_runs_of_the_tables(spark):
    text = prose(5, 400, 12)
    rows = [(i, text, "en") for i in range(40)]
    got = collocations.collocations(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_collocations(rows, 30, 2000))

import datetime as dt
import math
import random
import re
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.porter import stem
from memlake.functions import meets
from memlake.functions.stemming import stem_word
from memlake.operators import dedup as dd
from memlake.operators import keyword as kw
from memlake.operators import search as se
from memlake.operators.packs import define_packs, drop_packs, pack_line_order, pack_lines, pack_members, \
    parse_pack_defs, prompts
from memlake.operators.rules import Rules
from tests.conftest import UTC, rec


def t(h):
    return dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(hours=h)


# ------------------------------------------------------------ near duplicates

def brute_pairs(rows, threshold):
    """All unordered row pairs with Jaccard >= threshold (newer row first)."""
    order = sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))
    out = set()
    for i, (ia, ta, ca) in enumerate(order):
        for ib, tb, cb in order[i + 1:]:
            a, b = set(ca.lower().split()), set(cb.lower().split())
            if a and b and len(a & b) / len(a | b) >= threshold:
                out.add((ia, ib))
    return out


def expand(pairs_df, copies_df):
    """Row pairs from the compact output (copies and near pairs)."""
    members = {}
    for r in copies_df.collect():
        members.setdefault(r["rep_id"], []).append(r["id"])
    out = set()
    for rep, ms in members.items():
        group = [rep] + ms
        for i in range(len(group)):
            for j in range(i + 1, len(group)):
                out.add(frozenset((group[i], group[j])))
    for r in pairs_df.collect():
        for x in [r["id_a"]] + members.get(r["id_a"], []):
            for y in [r["id_b"]] + members.get(r["id_b"], []):
                out.add(frozenset((x, y)))
    return out


@pytest.mark.parametrize("first", [1, 4, 1000])
def test_newest_pairs_stop_early(make_records, first):
    rnd = random.Random(6)
    rows = [rec(str(i), " ".join(rnd.sample([f"w{j}" for j in range(9)], 7)), created=t(i // 2)) for i in range(40)]
    df = make_records(rows)
    want = dd.example_pairs(df, dd.near_duplicates(df, 0.7), n=3)
    assert sorted(tuple(r) for r in dd.newest_pairs(df, 0.7, 3, first).select(*want.columns).collect()) == sorted(map(tuple, want.collect()))
    assert dd.newest_pairs(df.limit(0), 0.7).collect() == []


def test_pairs_beyond_the_bound_are_dropped_in_the_join(make_records, monkeypatch):
    """Sets that share one word in ten of many: none of them is gathered as a candidate."""
    made = {}
    materialize = dd.materialize

    def counted(df, name="table"):
        made[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, name)
    monkeypatch.setattr(dd, "materialize", counted)
    rows = [rec(str(i), " ".join([f"s{(i + j) % 60}x{j}" for j in range(36)] + [f"w{j}" for j in range(4)]), created=t(i)) for i in range(120)]
    pairs = dd.near_duplicates(make_records(rows), 0.75)
    assert pairs.count() == 0
    assert dd.duplicate_copies(make_records(rows)).count() == 60
    assert "bit_count" in made["near-pairs"] and "Aggregate" in made["near-pairs"].split("bit_count")[0]      # under the grouping


def test_words_go_once_to_a_family(make_records, monkeypatch):
    """40 sets, nearly all pairs of them near: the words of a set go where its family meets, not to each of its pairs."""
    made = {}
    materialize = dd.materialize

    def kept(df, name="table"):
        out = materialize(df, name)
        made[name] = out.collect() if name == "near-dealt" else made.get(name)
        return out
    monkeypatch.setattr(dd, "materialize", kept)
    monkeypatch.setattr(dd, "LEAST", 64)
    rows = [rec(str(i), " ".join([f"w{j}" for j in range(60)] + [f"own{i}x{j}" for j in range(i % 4)]), created=t(i)) for i in range(40)]
    rows += [rec(str(100 + i), f"alone{i} other{i}", created=t(i)) for i in range(20)]
    assert dd.pair_count(make_records(rows), 0.75).first()["pairs"] == 780
    places = {(r["bucket"], k) for r in made["near-dealt"] for k in (r["ka"], r["kb"])}
    sets = {k for _, k in places}
    assert len(made["near-dealt"]) > 10 * len(sets) and len(places) <= 2 * len(sets)


@pytest.mark.parametrize("hot, part", [(1 << 15, 1 << 18), (3, 1 << 18), (2, 5)])
def test_meetings_and_overlaps_equal_brute_force(monkeypatch, hot, part):
    """Small and long sets, words of many sets cut into blocks, meetings looked at in parts: every pair that passes is
    met, and what sets share is counted."""
    monkeypatch.setattr(meets, "HOT", hot)
    monkeypatch.setattr(meets, "PART", part)
    monkeypatch.setattr(meets, "OUT", part)
    rnd = random.Random(hot)
    sets = [rnd.sample([f"w{j}" for j in range(12)], rnd.randint(1, 8)) for _ in range(60)]
    long = [f"long{j}" for j in range(1200)]
    sets += [rnd.sample(long, n) for n in (1200, 1150, 1000, 900, 600, 590, 440)]
    sets = sorted({tuple(sorted(s)) for s in sets})
    chance = np.random.default_rng(7)
    hashes = {w: int(chance.integers(1 << 63)) for w in sorted({w for s in sets for w in s})}
    name = {w: hashes[w] & 0xFFFFF for w in hashes}
    counts = np.bincount([name[w] for s in sets for w in s], minlength=1 << 20).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([[hashes[w] for w in s] for s in sets], pa.list_(pa.int64()))], names=["gid", "words"])
    for th in (0.5, 0.75, 1.0):
        want = {}
        for b in range(len(sets)):
            for a in range(len(sets)):
                inter = len(set(sets[a]) & set(sets[b]))
                if (len(sets[a]), a) < (len(sets[b]), b) and inter / (len(sets[a]) + len(sets[b]) - inter) >= th:
                    want[a, b] = len(sets[a]), len(sets[b]), inter
        dealt = pa.Table.from_batches(meets.deal(th, counts, 3, None)([batch])).to_pylist()
        met = set()
        for bucket in range(3):
            here = [x for x in dealt if x["bucket"] == bucket]
            if here:
                met |= {(r["ka"], r["kb"]) for part in meets.meetings(th)(iter(pa.Table.from_pylist(here).to_batches())) for r in part.to_pylist()}
        assert set(want) <= met and all((len(sets[a]), a) < (len(sets[b]), b) for a, b in met), th
        rows = [{"bucket": 0, "ka": a, "kb": b, "text": None} for a, b in met] + [{"bucket": 0, "ka": g, "kb": None, "text": " ".join(s)} for g, s in enumerate(sets)]
        schema = pa.schema([("bucket", pa.int32()), ("ka", pa.int64()), ("kb", pa.int64()), ("text", pa.string())])
        shared = {(r["ka"], r["kb"]): (r["na"], r["nb"], r["inter"])
                  for part in meets.overlaps(iter(pa.Table.from_pylist(rows, schema).to_batches())) for r in part.to_pylist()}
        assert set(shared) == met and {k: shared[k] for k in want} == want


def test_the_newer_set_comes_first(make_records):
    """Sets of n words and the same n plus m: n / (n + m), computed here."""
    sets = {str(k): [f"w{k}x{i}" for i in range(k + 4)] for k in range(6)}
    rows = [rec(i, " ".join(w), created=t(int(i))) for i, w in sets.items()]
    rows += [rec(i + "+", " ".join([*w, "more", "words"]), created=t(20 + int(i))) for i, w in sets.items()]
    got = {(r["id_a"], r["id_b"]): r["jaccard"] for r in dd.near_duplicates(make_records(rows), 0.7).collect()}
    want = {(i + "+", i): len(w) / (len(w) + 2) for i, w in sets.items() if len(w) / (len(w) + 2) >= 0.7}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and 0 < len(want) < 6


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_equal_brute_force(make_records, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["A", "a", "B"]
    rows = []
    for i in range(60):
        if i and rnd.random() < 0.2:
            words = rows[rnd.randrange(len(rows))][2].split()
            words = words + ([rnd.choice(vocab)] if rnd.random() < 0.5 else [])
        else:
            words = rnd.sample(vocab, rnd.randint(0, 6))
        rows.append((str(i), t(rnd.randint(0, 5)), " ".join(words)))
    df = make_records([rec(i, c, created=ts) for i, ts, c in rows])
    for th in (0.5, 0.75, 1.0):
        want = {frozenset(p) for p in brute_pairs(rows, th)}
        got = expand(dd.near_duplicates(df, th), dd.duplicate_copies(df))
        assert got == want, th
        n = dd.pair_count(df, th).first()["pairs"]
        assert n == len(want)


def test_near_duplicates_across_length_bands(make_records):
    """Sets of 1..24 words span many length bands; boundary ratios
    (e.g. 8 of 16 words at t = 0.5) must still meet."""
    rnd = random.Random(7)
    vocab = [f"v{i}" for i in range(30)]
    rows = []
    for i in range(80):
        if i and rnd.random() < 0.4:
            base = rows[rnd.randrange(len(rows))][2].split()
            words = base[: max(1, len(base) - rnd.randint(0, len(base) // 2))]
        else:
            words = rnd.sample(vocab, rnd.randint(1, 24))
        rows.append((str(i), t(rnd.randint(0, 5)), " ".join(words)))
    df = make_records([rec(i, c, created=ts) for i, ts, c in rows])
    for th in (0.5, 0.6, 0.75, 0.9):
        want = {frozenset(p) for p in brute_pairs(rows, th)}
        got = expand(dd.near_duplicates(df, th), dd.duplicate_copies(df))
        assert got == want, th


def test_empty_sets_ignored(make_records):
    df = make_records([rec("1", "   "), rec("2", ""), rec("3", "x y")])
    assert dd.near_duplicates(df).count() == 0 and dd.pair_count(df).first()["pairs"] == 0


def test_per_owner_scope(make_records):
    df = make_records([rec("1", "a b c d", created=t(1)), rec("2", "a b c d", created=t(2)),
                       rec("3", "a b c d", created=t(3))])
    df = df.withColumn("owner", F.when(F.col("id") == "3", "o2").otherwise("o1"))
    pc = {r["owner"]: r["pairs"] for r in dd.pair_count(df, by=["owner"]).collect()}
    assert pc == {"o1": 1, "o2": 0}


def test_no_cartesian_product_in_plans(make_records, spark):
    df = make_records([rec("1", "a b"), rec("2", "a b c")])
    for plan_df in (dd.near_duplicates(df), se.search(df, spark.createDataFrame([(1, "a b")], "query_id long, query string"))):
        plan = plan_df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# ------------------------------------------------------------------- search

def test_stemmer_passes_short_and_long():
    assert stem("is") == "is" and stem("runs") == "run"
    long_word = "x" * 65 + "ing"
    assert stem(long_word) == long_word


def fts(text):
    return [x for x in re.split(r"[^a-z0-9\x80-\U0010ffff]+", text.translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]


def brute_bm25(rows, query):
    docs = {i: fts(c) + fts(" ".join(tags)) for i, c, tags in rows}
    n = len(docs)
    avgdl = sum(len(v) for v in docs.values()) / n
    q = fts(query)
    out = {}
    for i, toks in docs.items():
        if not all(w in toks for w in set(q)):
            continue
        s = 0.0
        for w in q:
            nt = sum(1 for d in docs.values() if w in d)
            idf = max(math.log((n - nt + 0.5) / (nt + 0.5)), 1e-6)
            f = toks.count(w)
            s += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))
        out[i] = s
    return out


def test_bm25_matches_definition(spark, make_records):
    rows = [("1", "Python data pipelines in Python", ["python"]),
            ("2", "Cooking pasta and data", []),
            ("3", "ÉVI lives in Zürich; python fan", ["travel"]),
            ("4", "nothing relevant", []),
            ("5", "Data, data and more DATA", ["data"])]
    df = make_records([rec(i, c, tags=tg, created=t(k)) for k, (i, c, tg) in enumerate(rows)])
    queries = spark.createDataFrame([(1, "python"), (2, "data"), (3, "python data"), (4, "absent"),
                                     (5, "data data"), (6, "évi")], "query_id long, query string")
    got = {}
    for r in se.search(df, queries, limit=None, stem=False).collect():
        got[(r["query_id"], r["id"])] = r["score"]
    want = {}
    for qid, q in [(1, "python"), (2, "data"), (3, "python data"), (4, "absent"), (5, "data data"),
                   (6, "évi")]:
        for i, s in brute_bm25(rows, q).items():
            want[(qid, i)] = s
    assert set(got) == set(want)
    for k in want:
        assert abs(got[k] - want[k]) < 1e-9
    # a word in more than half of the rows scores the idf floor, not below zero
    assert all(v > 0 for v in got.values())


def test_search_stemmed_and_ranked(spark, make_records):
    df = make_records([rec("1", "She is running daily", created=t(1)),
                       rec("2", "Runs a marathon", created=t(2)),
                       rec("3", "Walks", created=t(3))])
    q = spark.createDataFrame([(1, "run")], "query_id long, query string")
    hits = se.search(df, q, limit=5, stem=True).orderBy("rank").collect()
    assert {r["id"] for r in hits} == {"1", "2"} and [r["rank"] for r in hits] == [1, 2]
    assert se.search(df, q, limit=5, stem=False).count() == 0


STRUCTURED = ("query_id long, all_terms array<string>, any_terms array<string>, none_terms array<string>, "
              "phrases array<string>, prefixes array<string>, field string")


def test_structured_search_combines_all_parts(spark, make_records):
    df = make_records([rec("1", "cat bird", created=t(1)), rec("2", "cat dog", created=t(2)), rec("3", "dog", created=t(3)),
                       rec("4", "case about a snake", created=t(4)), rec("5", "snake_case names", tags=["cat"], created=t(5)),
                       rec("6", "ÉVI has a cat", created=t(6))])
    q = spark.createDataFrame([
        (1, ["cat"], ["dog", "bird"], None, None, None, None), (2, ["snake_case"], None, None, None, None, None),
        (3, ["CAT"], None, ["dog"], None, None, "content"), (4, ["ÉVI"], None, None, None, None, None),
        (5, None, None, ["cat"], None, ["sna"], None), (6, None, None, None, ["cat dog"], None, None),
        (7, ["cat"], None, None, None, None, "tags"), (8, None, None, ["cat"], None, None, None),
        (9, ["absent"], ["cat"], None, None, None, None), (10, ["!!", "cat"], None, None, None, ["b"], None)], STRUCTURED)
    got = {}
    for r in se.structured_search(df, q, stem=False).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got == {1: {"1", "2"}, 2: {"5"}, 3: {"1", "6"}, 4: {"6"}, 5: {"4"}, 6: {"2"}, 7: {"5"}, 10: {"1"}}


def fts5(rows, tokenizer, queries):
    """(query, id) -> score of SQLite's full-text index over the same rows."""
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table f using fts5(id unindexed, content, tags, tokenize='{tokenizer}')")
    con.executemany("insert into f values (?, ?, ?)", rows)
    return {(n, i): -s for n, q in queries for i, s in con.execute("select id, bm25(f) from f where f match ?", (q,))}


WORDS = ("run running runs runner cat cats catalog category data database pipelines pipeline generously general agreed agree "
         "relational relate hopping hop sky skies happy happiness electric electricity ÉVI évi naïve aぁing ßing snake case").split()


@pytest.mark.parametrize("tokenizer", ["ascii", "porter ascii"])
def test_scores_equal_fts5(spark, make_records, tokenizer):
    rnd = random.Random(5)
    rows = [(str(i), " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(2, 14))), [rnd.choice(WORDS)] if i % 3 else []) for i in range(60)]
    df = make_records([rec(i, c, tags=tg, created=t(k)) for k, (i, c, tg) in enumerate(rows)])
    none = [None] * 6
    parts = {"a": 0, "o": 1, "n": 2, "p": 3, "x": 4, "f": 5}
    cases = [("run data", dict(a=["run", "data"])), ("cat OR hop", dict(o=["cat", "hop"])), ("pipeline NOT cats", dict(a=["pipeline"], n=["cats"])),
             ('"snake case"', dict(p=["snake case"])), ("cat*", dict(x=["cat"])), ("rela* AND run", dict(a=["run"], x=["rela"])),
             ("content : happiness", dict(a=["happiness"], f="content")), ("tags : (cat OR data OR sky)", dict(o=["cat", "data", "sky"], f="tags")),
             ('"run data" OR agreed', dict(o=["run data", "agreed"])), ("(sky OR happy) AND data NOT run", dict(a=["data"], o=["sky", "happy"], n=["run"]))]
    table = []
    for n, (_, how) in enumerate(cases):
        row = list(none)
        for k, v in how.items():
            row[parts[k]] = v
        table.append((n, *row))
    got = {(r["query_id"], r["id"]): r["score"] for r in se.structured_search(
        df, spark.createDataFrame(table, STRUCTURED), limit=None, stem="porter" in tokenizer).collect()}
    want = fts5([(i, c, " ".join(tg)) for i, c, tg in rows], tokenizer, [(n, q) for n, (q, _) in enumerate(cases)])
    assert set(got) == set(want) and len(want) > 100
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stems_equal_fts5_over_a_vocabulary(spark):
    rnd = random.Random(3)
    ends = ["", "s", "es", "ies", "ed", "eed", "ing", "ational", "tional", "izer", "ation", "fulness", "iviti", "icate", "ness", "ement", "ion", "sion",
            "tion", "ll", "e", "y", "li", "ousli", "logi", "bli", "aぁing", "éé", "ßß"]
    vocab = sorted({"".join(rnd.choice("abcdeiklmnoprstuyz") for _ in range(rnd.randint(1, 7))) + rnd.choice(ends) for _ in range(6000)})
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(w, tokenize='porter ascii')")
    con.execute("create virtual table v using fts5vocab('f', 'instance')")
    con.executemany("insert into f(rowid, w) values (?, ?)", list(enumerate(vocab, 1)))
    con.text_factory = bytes
    seen = dict(con.execute("select doc, term from v"))
    made = {r.term: r.stem for r in se.stem_vocabulary(spark.createDataFrame([(w,) for w in vocab], "term string")).collect()}
    wrong = [(w, made[w], seen[n]) for n, w in enumerate(vocab, 1) if n in seen and made[w].encode() != seen[n] and _whole(seen[n])]
    assert not wrong
    assert made == {w: stem(w) for w in vocab}


def _whole(raw: bytes) -> bool:
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


def test_stems_of_short_and_odd_terms_equal_plain_python(spark):
    rnd = random.Random(8)
    terms = ["y", "yy", "yes", "by", "sky", "ies", "eed", "bed", "sing", "x" * 70, "styying", "é", "漢字ing", "üeed", "11ed", None]
    terms += ["".join(rnd.choice("aeiouybcdlstz1é") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "ed", "ing", "ies", "yed", "ll"]) for _ in range(3000)]
    made = {r.term: r.stem for r in se.stem_vocabulary(spark.createDataFrame([(w,) for w in terms], "term string")).collect()}
    assert made == {w: stem(w) for w in terms}


def test_stems_are_computed_inside_the_jvm(spark, make_records):
    df = make_records([rec("1", "running runs")])
    plan = se.stem_vocabulary(se.tokens(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "regexp" in plan.lower()


@pytest.mark.parametrize("stem_too", [False, True])
def test_postings_are_made_where_the_row_is(spark, make_records, monkeypatch, stem_too):
    """No token is a row of its own on the way, and parts that share an id are one text."""
    plans = []
    materialize = se.materialize

    def kept(df, name="table"):
        if name == "postings":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)
    monkeypatch.setattr(se, "materialize", kept)
    rows = [rec("1", "Runs, running É éa run", tags=("run", "b")), rec("2", ""), rec("3", "", tags=("x",))]
    index = se.build_index(make_records(rows), stem=stem_too)
    got = sorted((r["term"], r["id"], r["tf"], r["content_at"], r["tags_at"]) for r in index.postings.collect())
    assert not [p for p in plans if "Generate" in p or "Aggregate" in p]
    run = [("run", "1", 4, [0, 1, 4], [0])] if stem_too else [("run", "1", 2, [4], [0]), ("running", "1", 1, [1], []), ("runs", "1", 1, [0], [])]
    assert got == sorted([("b", "1", 1, [], [1]), ("x", "3", 1, [], [0]), ("É", "1", 1, [2], []), ("éa", "1", 1, [3], []), *run])
    index.drop()
    index = se.build_index(make_records([rec("1", "a b a"), rec("1", "b c"), rec("2", "a")]), stem=stem_too)
    got = sorted((r["term"], r["id"], r["tf"], r["content_at"]) for r in index.postings.collect())
    assert got == [("a", "1", 2, [0, 2]), ("a", "2", 1, [0]), ("b", "1", 2, [0, 1]), ("c", "1", 1, [1])]
    index.drop()


def test_stems_of_single_terms_equal_those_of_the_table():
    rnd = random.Random(12)
    ends = ["", "s", "es", "ies", "ed", "eed", "ing", "ational", "izer", "ation", "fulness", "iviti", "ness", "ement", "sion", "ll", "e", "y", "yed", "sses", "éé"]
    for _ in range(20000):
        term = "".join(rnd.choice("aeiouybcdlstz1é") for _ in range(rnd.randint(1, 9))) + rnd.choice(ends)
        assert stem_word(term) == stem(term)


def widest_join(df):
    """Rows that the largest join of an executed query made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().get("numOutputRows").get().value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return most


def test_prefixes_join_no_more_rows_than_their_postings(spark, make_records):
    """Every row holds many words of one prefix: rows times words would be 30 times as much."""
    rows = [rec(str(i), " ".join(f"pre{(i * 7 + j) % 200} other{j}" for j in range(30)), created=t(i)) for i in range(200)]
    index = se.build_index(make_records(rows), stem=False)
    q = spark.createDataFrame([(1, None, None, None, None, ["pre"], None), (2, None, None, None, None, ["other1 pre"], None)], STRUCTURED)
    hits = se.structured_search(None, q, limit=None, index=index)
    assert widest_join(hits) <= 5 * 200 * 30
    got = {(r["query_id"], r["id"]) for r in hits.collect()}
    assert {i for n, i in got if n == 1} == {str(i) for i in range(200)} == {i for n, i in got if n == 2}
    index.drop()


@pytest.mark.parametrize("by", [(), ("owner",)])
def test_every_hit_is_that_of_a_deep_top(spark, make_records, monkeypatch, by):
    """All hits are scored by rows; with a limit, however large, by queries: same rows, scores and ranks, to the bit."""
    rnd = random.Random(11)
    vocab = ["run", "running", "ruin", "rust", "Röd", "a", "b", "c", "naïve"]
    rows = [rec(str(i % 70), " ".join(rnd.choices(vocab, k=rnd.randint(0, 12))), tags=rnd.sample(["run", "x y", "b"], rnd.randint(0, 2)), created=t(rnd.randint(0, 3)))
            for i in range(90)]
    df = make_records([*rows, rec("no id", "run a b c"), rec("no text", "")])
    df = df.withColumn("id", F.when(F.col("id") != "no id", F.col("id"))).withColumn("content", F.when(F.col("id") != "no text", F.col("content")))
    df = df.withColumn("owner", F.when(F.col("id") == "5", None).otherwise(F.col("confidence") + F.length("content") % 2))
    units = [None, [], None, None, ["a"], ["run", "a"], ["a b"], ["b c", "c"], ["nowhere"], ["ru"], ["a ru"]]
    table = [(n if n else None, *[rnd.choice(units) for _ in range(5)], rnd.choice([None, None, "content", "tags"])) for n in range(150)]
    q = spark.createDataFrame(table, STRUCTURED)
    if by:
        q = q.crossJoin(df.select("owner").distinct())
    for stem_too in (False, True):
        index = se.build_index(df, stem=stem_too, by=by)
        got = [tuple(r) for r in se.structured_search(None, q, limit=None, index=index).collect()]
        assert len(got) > 300
        assert sorted(got) == sorted(tuple(r) for r in se.structured_search(None, q, limit=10**6, index=index).collect())
        if not by and stem_too:
            monkeypatch.setattr(se, "UNITS", 3)         # more units than a task shall hold
            assert sorted(got) == sorted(tuple(r) for r in se.structured_search(None, q, limit=None, index=index).collect())
        index.drop()


def test_every_hit_is_sent_once_a_unit(spark, make_records, monkeypatch):
    """40 queries ask for a word that all rows hold, and for a prefix: no join makes a row a query and hit."""
    widest = {}
    materialize = se.materialize

    def kept(df, name="table"):
        if name in ("hits", "unit-hits"):
            widest[name] = widest_join(df)
        return materialize(df, name)
    monkeypatch.setattr(se, "materialize", kept)
    df = make_records([rec(str(i), f"all pre{i} pre{i + 1} other", created=t(i)) for i in range(100)])
    q = spark.createDataFrame([(n, ["all"], ["other", "nowhere"], None, None, ["pre"], None) for n in range(40)], STRUCTURED)
    assert se.structured_search(df, q, limit=None, stem=False).count() == 4000
    assert widest["hits"] <= 400 and widest["unit-hits"] == 0


def test_plain_terms_make_no_unit_tables(spark, make_records, monkeypatch):
    made = []
    materialize = se.materialize
    monkeypatch.setattr(se, "materialize", lambda df, name="table": made.append(name) or materialize(df, name))
    df = make_records([rec("1", "apple pie"), rec("2", "apple jam")])
    hits = se.search(df, spark.createDataFrame([(1, "apple jam")], "query_id long, query string"), stem=False)
    assert [r["id"] for r in hits.collect()] == ["2"]
    assert "hits" in made and not [n for n in made if n.startswith("unit-")]


def test_own_index_is_gone_after_the_query(spark, make_records):
    import os

    from memlake.session import checkpoint_dir
    df = make_records([rec("1", "apple pie", created=t(1)), rec("2", "apple jam", created=t(2))])
    q = spark.createDataFrame([(1, "apple")], "query_id long, query string")
    before = set(os.listdir(checkpoint_dir(spark)))
    assert se.search(df, q).count() == 2 and kw.keyword_search(df, q).count() == 2
    left = {x.split("-")[1] for x in set(os.listdir(checkpoint_dir(spark))) - before}
    assert left <= {"hits", "keyword"}


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_first_rows_of_keyword_search_equal_all_rows_cut(spark, make_records, limit):
    rnd = random.Random(limit)
    common, rare = ["a", "th", "the", "then"], [f"r{i}" for i in range(30)]
    rows = [rec(str(i), " ".join(rnd.choice(common if rnd.random() < 0.8 else rare) for _ in range(rnd.randint(0, 12))), created=t(i % 7)) for i in range(150)]
    q = spark.createDataFrame([(n, " ".join(rnd.choice(common + rare) for _ in range(rnd.randint(0, 9)))) for n in range(25)] + [(99, "absent THE a a")],
                              "query_id long, query string")
    df = make_records(rows)
    every = [tuple(r) for r in kw.keyword_search(df, q, limit=None).collect() if r["rank"] <= limit]
    assert sorted(every) == sorted(tuple(r) for r in kw.keyword_search(df, q, limit=limit).collect())


def test_equal_rows_do_not_raise_the_bound(spark, make_records):
    rows = [rec("1", "a b c d", created=t(1)), rec("2", "a b c", created=t(2)), rec("3", "a b", created=t(3)), rec("4", "a", created=t(4))]
    q = spark.createDataFrame([(1, "a b c d")], "query_id long, query string")
    got = kw.keyword_search(make_records(rows + rows), q, limit=3).collect()
    assert sorted((r["rank"], r["id"]) for r in got) == [(1, "1"), (2, "2"), (3, "3")]


def test_words_of_an_owner_meet_its_own_tokens_only(spark, make_records, monkeypatch):
    """Each owner holds words of its own that all hold "a": owners x words x tokens would be 40 times as much."""
    made = {}

    def counted(df, name="table"):
        out = materialize(df, name)
        made[name] = out.count()
        return out
    materialize = kw.materialize
    monkeypatch.setattr(kw, "materialize", counted)
    df = make_records([rec(str(i), " ".join(f"{i}a{j}" for j in range(10)), created=t(i)) for i in range(40)])
    df = df.withColumn("owner", F.col("id"))
    q = spark.createDataFrame([(str(i), 1, "a") for i in range(40)], "owner string, query_id long, query string")
    got = kw.keyword_search(df, q, by=["owner"]).collect()
    assert sorted((r["owner"], r["id"], r["score"]) for r in got) == sorted((str(i), str(i), 1) for i in range(40))
    assert made["keyword-asked"] == 400 and made["keyword-met"] <= 400      # of "a" in the owner's ten words, a tag besides


def test_index_upkeep_and_storage(spark, make_records, tmp_path):
    rows = [rec(str(i), f"common word{i} tail", created=t(i)) for i in range(6)]
    q = spark.createDataFrame([(1, "common"), (2, "word3"), (3, "word5 tail")], "query_id long, query string")

    def hits(index):
        return sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in se.search(None, q, None, index).collect())

    whole = se.build_index(make_records(rows), stem=False)
    grown = se.extend_index(se.build_index(make_records(rows[:4]), stem=False), make_records(rows[4:]))
    assert hits(grown) == hits(whole)
    changed = make_records([rec("3", "common other", created=t(9)), rec("8", "tail", created=t(8))])
    amended = se.amend_index(whole, changed, spark.createDataFrame([("3",), ("0",), ("none",)], "id string"))
    now = make_records([rows[i] for i in (1, 2, 4, 5)] + [rec("3", "common other", created=t(9)), rec("8", "tail", created=t(8))])
    assert hits(amended) == hits(se.build_index(now, stem=False))
    cut = se.shrink_index(whole, spark.createDataFrame([("3",), ("0",)], "id string"))
    assert hits(cut) == hits(se.build_index(make_records([rows[i] for i in (1, 2, 4, 5)]), stem=False))
    se.write_index(whole, str(tmp_path / "index"))
    assert hits(se.read_index(spark, str(tmp_path / "index"), stem=False)) == hits(whole)
    some = se.read_index(spark, str(tmp_path / "index"), stem=False, terms=["common", "word3", "word5", "tail"])
    assert hits(some) == hits(whole)


def test_owners_do_not_see_each_other(spark, make_records):
    df = make_records([rec("1", "apple pie"), rec("2", "apple jam"), rec("3", "pear")]).withColumn("owner", F.when(F.col("id") == "2", "b").otherwise("a"))
    q = spark.createDataFrame([("a", 1, "apple"), ("b", 1, "apple"), ("b", 2, "pear")], "owner string, query_id long, query string")
    for res in (se.search(df, q, stem=False, by=["owner"]), kw.keyword_search(df, q, by=["owner"]), se.routed_search(df, q, by=["owner"]),
                se.relevant(df, q, Rules(), by=["owner"])):
        assert sorted((r["owner"], r["query_id"], r["id"]) for r in res.collect()) == [("a", 1, "1"), ("b", 1, "2")]


def test_routing(spark):
    qs = ["python research", "", "user?", "what's up", "C++", "foo-bar", "NOT x", 'say "hi',
          "ends with.", "snake_case words", "a OR b", "x NEAR y", "café crème", "a AND b", "AND b"]
    df = spark.createDataFrame(list(enumerate(qs)), "query_id long, query string")
    got = {r["query"]: (r["mode"], r["has_phrase"]) for r in se.route_queries(df).collect()}
    ranked = {q for q, (m, _) in got.items() if m == "ranked"}
    assert ranked == {"python research", "snake_case words", "café crème", "a AND b"}
    assert got["snake_case words"] == ("ranked", True) and got["python research"][1] is False


def test_phrase_route(spark, make_records):
    df = make_records([rec("1", "snake case style", created=t(1)), rec("2", "case snake style", created=t(2)),
                       rec("3", "uses snake_case naming", created=t(3))])
    q = spark.createDataFrame([(1, "snake_case"), (2, "snake case")], "query_id long, query string")
    got = {(r["query_id"], r["id"]) for r in se.routed_search(df, q, limit=None, stem=False).collect()}
    assert got == {(1, "1"), (1, "3"), (2, "1"), (2, "2"), (2, "3")}


def test_relevant_filters_before_top_k(spark, make_records):
    df = make_records([rec("1", "apple pie", sensitive=True, created=t(3)),
                       rec("2", "apple jam", created=t(2)), rec("3", "apple tart", created=t(1))])
    q = spark.createDataFrame([(1, "apple")], "query_id long, query string")
    assert [r["id"] for r in se.relevant(df, q, Rules(), limit=1, stem=False).collect()] == ["2"]
    # The hits are a written table, so its rows show that the rules came first: hidden rows take no place of the first ones.
    many = make_records([rec(str(i), "apple" + " apple" * (i % 5), sensitive=i % 5 > 1, created=t(i)) for i in range(40)])
    hits = se.relevant(many, q, Rules(), limit=16, stem=False)
    assert sorted(r["rank"] for r in hits.collect()) == list(range(1, 17)) and {int(r["id"]) % 5 for r in hits.collect()} == {0, 1}


def test_keyword_search_semantics(spark, make_records):
    df = make_records([rec("1", "Team meeting about TEA", tags=["work"], created=t(1)),
                       rec("2", "apple and tea", created=t(2)),
                       rec("3", "nothing", created=t(3))])
    q = spark.createDataFrame([(1, "tea tea work"), (2, ""), (3, "app")], "query_id long, query string")
    got = {(r["query_id"], r["id"]): r["score"] for r in kw.keyword_search(df, q, limit=None).collect()}
    # substring matches ("tea" in "team"), repeats counted, tags searched too
    assert got == {(1, "1"): 3, (1, "2"): 2, (3, "2"): 1}
    top = kw.keyword_search(df, q, limit=1).filter("query_id = 1").first()
    assert top["id"] == "1"


# -------------------------------------------------------------------- packs

def test_packs_and_prompts(spark, seeded):
    defs = spark.createDataFrame([("work", "professional, project", "", "rust", "Work bits"),
                                  ("me", "personal,relationship", "", "", "")],
                                 "name string, categories string, tags string, exclude_tags string, "
                                 "description string")
    packs = parse_pack_defs(defs)
    m = pack_members(seeded, packs, Rules()).orderBy("pack", "cat_pos", F.col("created_at").desc()).collect()
    assert [(r["pack"], r["id"]) for r in m] == [("me", "n7"), ("me", "n3"), ("work", "n1"), ("work", "n8")]
    lines = [r["line"] for r in pack_lines(pack_members(seeded, packs, Rules()), packs)
             .orderBy(*pack_line_order()).collect()]
    assert lines[:3] == ["# me", "", "[PERSONAL] Reads Dutch crime novels."]
    assert "# Work bits" in lines
    redefined = define_packs(packs, spark.createDataFrame(
        [("me", "preference", "", "", "x")], "name string, categories string, tags string, "
                                              "exclude_tags string, description string"))
    assert {r["name"]: r["categories"] for r in redefined.collect()}["me"] == ["preference"]
    assert drop_packs(redefined, spark.createDataFrame([("me",)], "name string")).count() == 1
    tasks = spark.createDataFrame([(1, "rust help"), (2, "zzz")], "query_id long, query string")
    pr = {r["query_id"]: r["prompt"] for r in prompts(seeded, tasks, Rules()).collect()}
    assert pr[2] == "zzz"
    assert pr[1].startswith("## Personal Context\n[PROJECT] Learns Rust")
    assert pr[1].endswith("\n\n---\n\nrust help")


def test_results_independent_of_partitioning(spark, make_records):
    rnd = random.Random(7)
    vocab = ["red", "green", "blue", "cyan", "teal", "gold", "rose", "jade"]
    rows = [rec(str(i), " ".join(rnd.sample(vocab, rnd.randint(2, 6))), created=t(rnd.randint(0, 50)))
            for i in range(80)]
    base = make_records(rows)
    q = spark.createDataFrame([(1, "red blue"), (2, "gold")], "query_id long, query string")
    def snap(df):
        return (sorted(tuple(r) for r in dd.near_duplicates(df, 0.6).collect()),
                dd.pair_count(df, 0.6).first()["pairs"],
                sorted((r["query_id"], r["id"], round(r["score"], 9), r["rank"])
                       for r in se.search(df, q, limit=3, stem=False).collect()),
                sorted(tuple(r) for r in kw.keyword_search(df, q, limit=3).collect()))
    assert snap(base.repartition(1)) == snap(base.repartition(7)) == snap(base.repartition(3, "category"))

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import changes as ch
from memlake.operators import filters as fl
from memlake.operators import reports as rp
from memlake.operators.audit import audit, audit_summary
from memlake.operators.dedup import check_keys, dedup_batch, new_rows
from memlake.operators.rules import Rules
from memlake.schema import validate
from memlake.sources import table as tb
from tests.conftest import AS_OF, UTC, rec


def ids(df):
    return [r["id"] for r in df.collect()]


def test_filters_and_order(seeded):
    assert ids(fl.by_category(seeded, "personal")) == ["n7", "n6", "n4"]
    assert ids(fl.by_source(seeded, "gemini")) == ["n7", "n4", "n2"]
    assert ids(fl.sensitive(seeded)) == ["n6", "n4"]
    assert ids(fl.stale(seeded, dt.datetime(2024, 7, 1, tzinfo=UTC), 180)) == ["n1", "n2", "n3", "n4", "n5", "n6"]
    assert fl.stale(seeded.limit(0), AS_OF).count() == 0


def test_lookups(spark, seeded):
    keys = spark.createDataFrame([("n1",), ("zz",), ("n1",)], "id string")
    assert ids(fl.lookup(seeded, keys)) == ["n1"]
    ex = {r["id"]: r["exists"] for r in fl.id_exists(seeded, keys).collect()}
    assert ex == {"n1": True, "zz": False}
    texts = spark.createDataFrame([("Sister lives in Oslo.",), ("sister lives in oslo.",)], "content string")
    got = {r["content"]: r["exists"] for r in fl.content_exists(seeded, texts).collect()}
    assert got == {"Sister lives in Oslo.": True, "sister lives in oslo.": False}


def test_paging(seeded):
    assert ids(fl.page(seeded, 2, 1)) == ["n7", "n6"]
    rows, total = fl.visible_page(seeded, Rules(), limit=2, offset=0)
    assert ids(rows) == ["n8", "n7"] and total.first()["total_visible"] == 6
    assert ids(fl.visible_category(seeded, "personal", Rules())) == ["n7"]


def test_counts_and_stats(seeded):
    assert rp.count_all(seeded).first()["n"] == 8
    by_src = {r["source"]: r["n"] for r in rp.count_by_source(seeded).collect()}
    assert by_src == {"obsidian": 4, "gemini": 3, "manual": 1}
    by_cat = {r["category"]: r["n"] for r in rp.count_by_category(seeded).collect()}
    assert sum(by_cat.values()) == 8
    st = {(r["metric"], r["key"]): r["value"]
          for r in rp.stats(seeded, dt.datetime(2024, 7, 1, tzinfo=UTC), Rules()).collect()}
    assert st[("total", None)] == 8 and st[("sensitive", None)] == 2 and st[("stale", None)] == 6
    assert st[("by_source", "gemini")] == 3 and st[("rule", "exclude_sensitive=true")] == 1


def test_missing_categories_per_owner(seeded):
    assert [r["category"] for r in rp.missing_categories(seeded.filter("id <> 'n3'")).collect()] == \
        ["relationship"]
    owned = seeded.withColumn("owner", F.when(F.col("id").isin("n1", "n2"), "x").otherwise("y"))
    got = sorted((r["owner"], r["category"]) for r in rp.missing_categories(owned, by=["owner"]).collect())
    assert ("x", "personal") in got and ("y", "professional") in got and len(got) == 3 + 1


def test_health_score(spark, seeded):
    pairs = spark.createDataFrame([(2,)], "pairs bigint")
    inputs = rp.health_inputs(seeded, dt.datetime(2024, 7, 1, tzinfo=UTC), pairs)
    h = rp.health(inputs).first()
    # stale 6/8 -> 75% capped at 30; pairs 2 -> 10; no missing category
    assert (h["total"], h["stale"], h["pairs"], h["missing"]) == (8, 6, 2, 0)
    assert h["score"] == 60 and h["grade"] == "C" and h["review_tip"] is True
    assert rp.health(rp.health_inputs(seeded.limit(0), AS_OF, pairs.limit(0))).count() == 0


def test_audit_patterns(make_records):
    df = make_records([
        rec("1", "mail me at jo.doe+x@example.co.uk"),
        rec("2", "call (555) 123-4567 today"),
        rec("3", "token SK-abcdefghij1234 leaked", sensitive=True),
        rec("4", "ssn 123-45-6789"),
        rec("5", "card 4111 1111 1111 1111"),
        rec("6", "nothing here 12-34"),
    ])
    got = sorted((r["id"], r["label"]) for r in audit(df).collect())
    assert ("1", "email") in got and ("2", "phone") in got and ("3", "api_key") in got
    assert ("4", "ssn") in got and ("5", "credit_card") in got
    assert not [g for g in got if g[0] == "6"]
    summ = {(r["metric"], r["key"]): r["value"] for r in audit_summary(audit(df), df).collect()}
    assert summ[("rows_scanned", None)] == 6 and summ[("issues", None)] == len(got)
    assert summ[("by_sensitive", "true")] == 1


def test_exact_dedup(spark, make_records, seeded):
    inc = make_records([rec("x1", "New one"), rec("x2", "Sister lives in Oslo."), rec("x3", "New one")])
    inc = inc.withColumn("file", F.lit("f")).withColumn("pos", F.col("id"))
    assert ids(new_rows(seeded, inc).orderBy("id")) == ["x1", "x3"]
    assert ids(dedup_batch(inc)) and sorted(ids(dedup_batch(inc))) == ["x1", "x2"]
    assert ids(check_keys(seeded, make_records([rec("n1", "dup id")]))) == ["n1"]


def test_updates(spark, seeded):
    chg = spark.createDataFrame([("n1", "Updated content", None, None), ("nope", "x", None, None)],
                                "id string, content string, category string, tags array<string>")
    new, rejected, rep = ch.apply_updates(seeded, chg, AS_OF)
    row = new.filter("id = 'n1'").first()
    assert row["content"] == "Updated content" and row["category"] == "professional"
    assert row["tags"] == ["trade"] and row["updated_at"] == AS_OF.replace(tzinfo=None)
    assert {r["metric"]: r["value"] for r in rep.collect()} == {"matched": 1, "not_found": 1, "rejected": 0}
    clear = spark.createDataFrame([("n1", "c", "project", [])],
                                  "id string, content string, category string, tags array<string>")
    r2 = ch.apply_updates(seeded, clear, AS_OF)[0].filter("id = 'n1'").first()
    assert r2["tags"] == [] and r2["category"] == "project"


def test_edits_and_flags(spark, seeded):
    e = spark.createDataFrame([("n3", "", None, " cats , pets")], "id string, content string, category string, tags string")
    row = ch.apply_edits(seeded, e, AS_OF)[0].filter("id = 'n3'").first()
    assert row["content"] == "Sister lives in Oslo." and row["tags"] == ["cats", "pets"]
    s = spark.createDataFrame([("n3", True, 1), ("n3", False, 2)], "id string, sensitive boolean, seq int")
    new, _ = ch.apply_sensitive(seeded, s, AS_OF)
    assert new.filter("id = 'n3'").first()["sensitive"] is False
    s2 = spark.createDataFrame([("n3", True)], "id string, sensitive boolean")
    assert ch.apply_sensitive(seeded, s2, AS_OF)[0].filter("sensitive").count() == 3


def test_deletes_and_clears(spark, seeded):
    new, rep = ch.delete_ids(seeded, spark.createDataFrame([("n1",), ("zz",)], "id string"))
    assert new.count() == 7 and {r["metric"]: r["value"] for r in rep.collect()}["not_found"] == 1
    new, rep = ch.clear_source(seeded, "gemini")
    assert new.count() == 5 and rep.first()["value"] == 3
    new, rep = ch.clear_all(seeded)
    assert new.count() == 0 and rep.first()["value"] == 8 and new.schema == seeded.schema


def test_invalid_category_change_is_flagged(spark):
    c = spark.createDataFrame([("n1", "x", "hobbies"), ("n2", None, None), ("n3", "fine", "")], "id string, content string, category string")
    good, rejected = ch.split_changes(c)
    assert ids(good) == ["n3"]
    assert {r["id"]: r["problems"] for r in rejected.collect()} == {"n1": ["bad_category"], "n2": ["missing_content"]}


def test_invalid_changes_are_not_applied(spark, seeded):
    c = spark.createDataFrame([("n1", None, "bogus"), ("n2", "new", "personal")], "id string, content string, category string")
    new, rejected, rep = ch.apply_updates(seeded, c, AS_OF)
    assert validate(new)[1].count() == 0 and new.filter("id = 'n1'").first()["category"] == "professional"
    assert ids(rejected) == ["n1"] and {r["metric"]: r["value"] for r in rep.collect()} == {"matched": 1, "not_found": 0, "rejected": 1}


def test_repeated_changes_need_an_order(spark, seeded):
    c = spark.createDataFrame([("n1", "x"), ("n1", "y")], "id string, content string")
    with pytest.raises(Exception, match="seq"):
        ch.apply_updates(seeded, c, AS_OF)[0].collect()


def test_validate(make_records, spark):
    good, bad = validate(make_records([rec("1", "ok"), rec("2", "bad", category="hobby")]))
    assert ids(good) == ["1"] and bad.first()["problems"] == ["bad_category"]


def test_snapshot_export_roundtrip(spark, seeded, tmp_path):
    base = str(tmp_path / "table")
    tb.write_snapshot(seeded, base, 1)
    assert tb.latest_version(spark, base) == 1
    back = tb.read_table(spark, tb.snapshot_path(base, 1))
    assert sorted(ids(back)) == sorted(ids(seeded))
    new, _ = ch.delete_ids(back, spark.createDataFrame([("n1",)], "id string"))
    tb.write_snapshot(new, base, 2)
    assert tb.latest_version(spark, base) == 2
    assert tb.read_table(spark, tb.snapshot_path(base, 2)).count() == 7
    out = str(tmp_path / "export")
    n = tb.export_json(back, out).first()["rows"]
    assert n == 8
    files = [f for f in os.listdir(out) if f.endswith(".json")]
    row = json.loads(open(os.path.join(out, files[0])).readline())
    assert "source_raw" not in row and {"content", "source", "sensitive"} <= set(row)
    assert tb.export_json(back, str(tmp_path / "e2"), source="gemini").first()["rows"] == 3


def test_upgrade_schema_adds_sensitive(spark, tmp_path):
    legacy = spark.createDataFrame(
        [("1", "old row", "manual", "personal", '["a"]', 1, 0.8, "2024-01-01T00:00:00+00:00",
          "2024-01-01T00:00:00+00:00", None)],
        "id string, content string, source string, category string, tags string, sensitive int, "
        "confidence double, created_at string, updated_at string, source_raw string")
    dec = tb.decode_legacy(legacy).first()
    assert dec["tags"] == ["a"] and dec["sensitive"] is True
    no_flag = tb.decode_legacy(legacy).drop("sensitive")
    up = tb.upgrade_schema(no_flag).first()
    assert up["sensitive"] is False


def test_short_forms(seeded):
    from memlake.functions.render import render_hit, render_short
    row = seeded.filter("id = 'n6'").select(
        render_short(F.lit(7)).alias("line"), render_short(F.lit(12), verbose=True, as_of=dt.datetime(2023, 12, 30, tzinfo=UTC)).alias("more"),
        render_hit(F.lit(1)).alias("hit")).first()
    assert row["line"] == "  7. [obsidian] [personal    ] Blood pressure is checked monthly. [SENSITIVE]"
    assert row["more"].split("\n")[1:] == ["     Tags: health, routine", "     ID: n6  |  Age: 2d"]
    assert row["hit"].endswith("[SENSITIVE]\n   Tags: health, routine")


def test_page_for_every_owner(seeded):
    owned = seeded.withColumn("owner", F.col("source"))
    got = {(r["owner"], r["id"]) for r in fl.page(owned, 1, 1, by=["owner"]).collect()}
    assert got == {("obsidian", "n6"), ("gemini", "n4")}


LOG = "seq long, op string, id string, content string, category string, tags array<string>, sensitive boolean, source string, tag_text string"


def applied_one_by_one(rows, log):
    """Brute force over dicts of records."""
    state = {r[0]: dict(content=r[1], source=r[2], category=r[3], tags=list(r[4]), sensitive=r[5], touched=False) for r in rows}
    for _, op, i, content, category, tags, flag, source, text in sorted(log, key=lambda e: e[0]):
        if op == "clear_all":
            state.clear()
        elif op == "clear_source":
            state = {k: v for k, v in state.items() if v["source"] != source}
        elif i not in state:
            continue
        elif op == "delete":
            del state[i]
        elif op in ("update", "edit"):
            if category == "bogus" or (op == "update" and content is None):
                continue
            row = state[i]
            row["touched"] = True
            if op == "update" or content:
                row["content"] = content
            row["category"] = category or row["category"]
            if op == "update" and tags is not None:
                row["tags"] = tags
            if op == "edit" and text:
                row["tags"] = [x.strip() for x in text.split(",")]
        else:
            state[i]["sensitive"], state[i]["touched"] = flag, True
    return sorted((k, v["content"], v["category"], v["tags"], v["sensitive"], v["touched"]) for k, v in state.items())


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_log_equals_its_entries_one_by_one(spark, make_records, seed):
    rnd = random.Random(seed)
    rows = [rec(str(i), f"text {i}", source=rnd.choice(["claude", "manual"]), tags=["t"]) for i in range(12)]
    log = []
    for seq in rnd.sample(range(1000), 60):
        log.append((seq, rnd.choice(["update", "edit", "edit", "sensitive"] * 5 + ["delete"]), str(rnd.randrange(14)), rnd.choice([None, "", f"new {seq}"]),
                    rnd.choice([None, "", "project", "bogus"]), rnd.choice([None, [], ["x", "y"]]), rnd.random() < 0.5, None, rnd.choice([None, "", "a, b,"])))
    if seed == 3:
        log.append((400, "clear_source", None, None, None, None, None, "claude", None))
    if seed == 4:
        log.append((990, "clear_all", None, None, None, None, None, None, None))
    new, rejected = ch.apply_log(make_records(rows), spark.createDataFrame(log, LOG), AS_OF)
    got = sorted((r["id"], r["content"], r["category"], list(r["tags"]), r["sensitive"], r["updated_at"] != r["created_at"]) for r in new.collect())
    assert got == applied_one_by_one(rows, log)
    bad = [e for e in log if e[1] in ("update", "edit") and (e[4] == "bogus" or (e[1] == "update" and e[3] is None))]
    assert rejected.count() == len(bad)


def test_page_after_equals_the_page_by_offset(make_records):
    rows = [rec(str(i), "x", created=dt.datetime(2024, 1, 1 + i % 4, tzinfo=dt.timezone.utc)) for i in range(30)]
    df = make_records(rows)
    for at in (0, 6, 25, 29):
        last = fl.page(df, 1, at).first()
        after = fl.page_after(df, last["created_at"], last["id"], 10).collect()
        assert [r["id"] for r in after] == [r["id"] for r in fl.page(df, 10, at + 1).collect()]

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators.ingest import import_records, manual_records, plan_import
from memlake.sources.arrays import array_elements, parse_array_elements
from memlake.sources.exports import ingest_summary, parse_document_rows, read_exports, reject_counts
from memlake.util import drop_materialized
from tests.conftest import AS_OF, UTC


def write(tmp_path, name, doc):
    p = tmp_path / name
    p.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(p)


def parse(spark, tmp_path, doc, platform, name="export.json"):
    path = write(tmp_path, name, doc)
    recs, rej = read_exports(spark, path, platform, as_of=AS_OF)
    return recs.orderBy("pos").collect(), rej.orderBy("pos").collect()


def test_array_of_objects(spark, tmp_path):
    spots = [("Plays the viola in a quartet.", "2023-07-09T21:15:30+01:00"), ("\t", "2023-07-10"), ("Keeps two hens.", None), ("", "x")]
    recs, rej = parse(spark, tmp_path, [{"memory": m, "created_at": c} for m, c in spots], "chatgpt")
    assert [(r["pos"], r["reason"]) for r in rej] == [(1, "blank"), (3, "blank")]
    assert [(r["pos"], r["content"], r["created_at"]) for r in recs] == [
        (0, spots[0][0], dt.datetime(2023, 7, 9, 20, 15, 30)), (2, spots[2][0], AS_OF.replace(tzinfo=None))]
    for r in recs:
        assert (r["updated_at"], r["source_raw"], r["source"], r["confidence"]) == (r["created_at"], r["content"], "chatgpt", 0.85)


def test_most_keyword_hits_win(spark, tmp_path):
    from memlake.sources.platforms import PLATFORMS
    rules = PLATFORMS["chatgpt"].category_rules
    texts = [" ; ".join(dict.fromkeys(kws[:4])) for _, kws in rules] + ["qqq"]
    recs, _ = parse(spark, tmp_path, [{"memory": x} for x in texts], "chatgpt")

    def expected(text):
        hits = [sum(k in text.lower() for k in kws) for _, kws in rules]
        return rules[hits.index(max(hits))][0] if max(hits) else "personal"
    assert [r["category"] for r in recs] == [expected(x) for x in texts]


def test_strings_and_objects(spark, tmp_path):
    doc = ["Collects old maps.", {"content": "Sings bass.", "created_at": "bad"}, 7, None,
           ["nested"], {"memory": 12}]
    recs, rej = parse(spark, tmp_path, doc, "claude")
    assert [r["content"] for r in recs] == ["Collects old maps.", "Sings bass."]
    # a bare string and an unparseable time both take as_of
    assert recs[0]["created_at"] == AS_OF.replace(tzinfo=None)
    assert recs[1]["created_at"] == AS_OF.replace(tzinfo=None)
    assert [r["reason"] for r in rej] == ["wrong_element_type", "wrong_element_type",
                                         "wrong_element_type", "bad_text_type"]
    assert all(r["confidence"] == 0.92 for r in recs)


def test_chatgpt_rejects_bare_strings(spark, tmp_path):
    recs, rej = parse(spark, tmp_path, ["just text"], "chatgpt")
    assert recs == [] and rej[0]["reason"] == "wrong_element_type"


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        read_exports(spark, str(tmp_path / "nope.json"), "claude", as_of=AS_OF)[0].collect()


def test_wrapper_object_and_keys(spark, tmp_path):
    doc = {"memories": [{"text": "Rows on the canal.", "timestamp": "2024-05-05T05:05:05+02:00"}]}
    recs, _ = parse(spark, tmp_path, doc, "gemini")
    assert len(recs) == 1 and recs[0]["source"] == "gemini"
    assert recs[0]["created_at"] == dt.datetime(2024, 5, 5, 3, 5, 5)


def test_empty_wrapper_falls_through_to_items(spark, tmp_path):
    doc = {"memories": [], "items": [{"title": "Reads science fiction."}, "Plays chess."]}
    recs, _ = parse(spark, tmp_path, doc, "gemini")
    assert [r["content"] for r in recs] == ["Reads science fiction.", "Plays chess."]


def test_unparseable_file_is_one_reject(spark, tmp_path):
    recs, rej = parse(spark, tmp_path, "{not json", "gemini")
    assert recs == [] and len(rej) == 1 and rej[0]["reason"] == "unparseable"


def test_confidence_order(spark, tmp_path):
    doc = [{"memory": "Grinds lenses.", "created_at": "2022-02-02"}]
    a, _ = parse(spark, tmp_path, doc, "chatgpt", "a.json")
    b, _ = parse(spark, tmp_path, doc, "claude", "b.json")
    assert b[0]["confidence"] > a[0]["confidence"]


def test_naive_time_read_as_utc(spark, tmp_path):
    recs, _ = parse(spark, tmp_path, [{"memory": "x y", "created_at": "2024-02-02T10:00:00"}], "chatgpt")
    assert recs[0]["created_at"] == dt.datetime(2024, 2, 2, 10, 0)


def test_tags_map_order_and_cap(spark, tmp_path):
    text = "python rust javascript typescript coffee music jazz dog"
    recs, _ = parse(spark, tmp_path, [{"memory": text}], "chatgpt")
    assert recs[0]["tags"] == ["python", "rust", "javascript", "typescript", "coffee"]


def test_summary_and_reject_counts(spark, tmp_path):
    path = write(tmp_path, "e.json", ["Has a cat.", "", 3, "Loves coffee."])
    _, rej = read_exports(spark, path, "claude", as_of=AS_OF)
    docs = spark.read.text(path, wholetext=True).selectExpr("'e' as file", "value")
    s = {(r["metric"], r["key"]): r["value"] for r in ingest_summary(parse_document_rows(docs, "claude", AS_OF)).collect()}
    assert s[("parsed", None)] == 2 and s[("skipped", None)] == 2
    rc = {(r["reason"]): r["n"] for r in reject_counts(rej).collect()}
    assert rc == {"blank": 1, "wrong_element_type": 1}


def test_import_dedup_within_and_across(spark, tmp_path, make_records):
    p1 = write(tmp_path, "one.json", [{"memory": "Same text."}, {"memory": "Other text."},
                                      {"memory": "Same text."}])
    recs, _ = read_exports(spark, p1, "chatgpt", as_of=AS_OF)
    empty = make_records([])
    table, report = import_records(empty, recs)
    rep = {(r["metric"], r["key"]): r["value"] for r in report.collect()}
    assert rep[("added", None)] == 2 and rep[("duplicates", None)] == 1 and rep[("total", None)] == 2
    # the first copy in input order wins
    kept = {r["content"]: r["id"] for r in table.collect()}
    first = recs.filter("pos = 0").first()["id"]
    assert kept["Same text."] == first
    # a second import of the same file adds nothing
    table2, report2 = import_records(table, recs)
    rep2 = {(r["metric"], r["key"]): r["value"] for r in report2.collect()}
    assert rep2.get(("added", None), 0) == 0 and table2.count() == 2


def test_plan_import_is_a_dry_run(spark, tmp_path, make_records, seeded):
    p = write(tmp_path, "x.json", [{"memory": "Sister lives in Oslo."}, {"memory": "New fact."}])
    recs, _ = read_exports(spark, p, "chatgpt", as_of=AS_OF)
    plan = {r["content"]: r["action"] for r in plan_import(seeded, recs).collect()}
    assert plan == {"Sister lives in Oslo.": "duplicate", "New fact.": "insert"}
    assert seeded.count() == 8


def test_manual_records_defaults(spark):
    df = spark.createDataFrame([("Keeps bees.", "personal")], "content string, category string")
    r = manual_records(df, AS_OF).first()
    assert (r["source"], r["confidence"], r["sensitive"], r["tags"]) == ("manual", 0.9, False, [])
    assert r["created_at"] == AS_OF.replace(tzinfo=None)


def test_iso_times_only(spark):
    from memlake.functions.timefn import parse_ts
    d = dt.datetime
    want = {"2024-01-15": d(2024, 1, 15), "20240115T103000": d(2024, 1, 15, 10, 30), "2024-01-15 10:30": d(2024, 1, 15, 10, 30),
            "2024-01-15T10:30:05.25Z": d(2024, 1, 15, 10, 30, 5, 250000), "2024-01-15T10:30:05-0130": d(2024, 1, 15, 12, 0, 5),
            "2024-01-15T10+02": d(2024, 1, 15, 8), "12:30": None, "2024": None, "2024-01": None, "2024-02-30": None, "": None, "soon": None, None: None}
    df = spark.createDataFrame([(k,) for k in want], "x string").select("x", parse_ts("x", AS_OF).alias("t"))
    assert {r["x"]: r["t"] for r in df.collect()} == {k: v or AS_OF.replace(tzinfo=None) for k, v in want.items()}


def test_json_lines_files(spark, tmp_path):
    path = write(tmp_path, "many.jsonl", "\n".join(json.dumps({"memory": f"Line {i} of the file."}) for i in range(3000)) + "\n{broken\n")
    recs, rej = read_exports(spark, path, "claude", as_of=AS_OF, lines=True)
    rows = recs.orderBy("pos").collect()
    assert [r["content"] for r in rows] == [f"Line {i} of the file." for i in range(3000)]
    assert len({r["id"] for r in rows}) == 3000 and [r["reason"] for r in rej.collect()] == ["unparseable"]


def test_a_hot_text_meets_in_no_single_task(spark, make_records):
    """Every row of one third of the batch holds the same text: no join task gets more than its share of them."""
    n = 6000
    inc = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("t"), F.col("id").cast("string"))).alias("content"), F.lit("f").alias("file"), F.col("id").alias("pos"))
    planned = plan_import(make_records([]), inc)
    assert planned.filter("action = 'insert'").count() == n - n // 3 + 1
    joined = planned.select(F.spark_partition_id().alias("p"), "pos").groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(joined) == 1 or max(r["n"] for r in joined) < 2 * n / len(joined)


def test_large_arrays_read_in_splits_equal_whole_files(spark, tmp_path):
    chance = random.Random(3)
    odd = ['He said "a, b], [c" twice', "back\\slash, and \\", "{not, an: object}", "", "  ", "ünï, 漢字,  ", "\\\",\"", "x" * 3000, "tab\t, line\n, [[["]
    files = {"empty.json": "[]", "blank.json": " [ \n ] \n", "object.json": '{"memories": [1, 2]}', "cut.json": '[{"memory": "a"}, {"memory": "b',
             "one.json": '["only, one"]', "nothing.json": ""}
    for f in range(3):
        elements = []
        for i in range(250):
            text = " ".join(chance.choices(odd, k=chance.randrange(1, 4))) + f" {i}"
            elements.append(chance.choice([text, {"memory": text}, {"content": text, "tags": ["a,b", ["c", {"d": [1, 2]}]]}, [text, [text]], 7, None,
                                           {"memory": ""}, {"content": text, "created_at": "2024-01-02T03:04:05"}]))
        files[f"big{f}.json"] = json.dumps(elements, ensure_ascii=f == 1, indent=f or None)
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    whole = [x.collect() for x in read_exports(spark, str(tmp_path), "claude", as_of=AS_OF)]
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("16000", "2500"):
        spark.conf.set(key, size)
        try:
            elements = array_elements(spark, str(tmp_path))
            recs, rejects = (x.collect() for x in parse_array_elements(elements, "claude", AS_OF))
        finally:
            spark.conf.set(key, before)
        drop_materialized(elements)
        assert len(recs) > 300
        assert sorted(map(str, recs)) == sorted(map(str, whole[0]))
        name = lambda r: (r["file"].rsplit("/", 1)[1], r["pos"], r["reason"], r["raw"])
        assert sorted(map(str, map(name, rejects))) == sorted(map(str, map(name, whole[1])))


def test_an_element_that_is_no_json_is_one_reject(spark, tmp_path):
    elements = array_elements(spark, write(tmp_path, "a.json", '["first", {"memory": oops, "x": 1}, "third",]'))
    recs, rejects = parse_array_elements(elements, "claude", AS_OF)
    assert sorted((r["pos"], r["content"]) for r in recs.collect()) == [(0, "first"), (2, "third")]
    assert sorted((r["pos"], r["reason"]) for r in rejects.collect()) == [(1, "unparseable"), (3, "unparseable")]
    drop_materialized(elements)
    elements = array_elements(spark, write(tmp_path, "b.json", '["a", "b"] x'))
    assert [(r["pos"], r["file_error"]) for r in elements.collect()] == [(None, "unparseable")]
    drop_materialized(elements)

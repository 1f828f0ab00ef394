import ast
import os

import corpus_pipeline as P

from .helpers import contaminated, frame, prose

HERE = os.path.dirname(os.path.abspath(__file__))


def test_stages_on_given_tables_follow_their_operators(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = P.staged(stage(spark, docs, sf_dir), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(after) == {i for i, *_, bad in contaminated([(i, r.text) for i, r in before.items()], items) if not bad}
        if name == "pii":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert all(before[i] == r for i, r in after.items())
    assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, sf_dir).collect()} == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in P.run(spark, sf_dir).collect()} == {r.doc_id for r in docs.collect()}


def test_stages_keep_awkward_rows_and_columns(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, prose(1, 40)), (3, prose(2, 40)), (4, prose(2, 40)), (5, "Mail a@b.org " + prose(3, 40))]
    docs = frame(spark, rows).selectExpr("*", "7L as n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 2, None, 3, 5} and got[1].text is None and got[1].n_chars == 7 and "a@b.org" not in got[5].text
    assert {r.doc_id for r in P.pack_windows(spark, docs, "").collect()} == set(got)
    assert P.pack_windows(spark, docs.limit(0), "").collect() == []


def test_native_operators_hold_no_python():
    for name in ("secrets", "decontamination", "quality", "pii"):
        tree = ast.parse(open(os.path.join(HERE, "..", "..", "memlake", "llm", f"{name}.py"), encoding="utf-8").read())
        used = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)} | {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
        assert not used & {"mapInArrow", "mapInPandas", "applyInPandas", "pandas_udf", "udf", "rdd", "toPandas", "numpy", "pandas"}

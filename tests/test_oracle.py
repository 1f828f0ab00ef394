"""Every registered query equals its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="synthetic tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["category", "n"]


def test_every_query_has_an_oracle_or_is_declared():
    missing = set(E.queries()) - set(E.oracle_sql())
    assert {m for m in missing if not m.startswith("op") and m != "pipeline"} == set()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    a, ac = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(E.oracle_sql()[name])
    b, bc = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert ac == bc
    assert a == b


#: These write a table (an index, groups of copies, a snapshot) before their result is defined.
MATERIALISE = {"search_bm25", "search_bm25_stemmed", "relevant", "routed_search", "phrase_search", "structured_search", "search_by_owner",
               "index_stats", "index_after_changes", "page_after", "keyword_search", "keyword_by_owner", "render_hits", "prompts", "prompts_by_owner", "near_duplicates", "duplicate_copies", "near_duplicate_pairs", "health", "health_examples", "export_json", "snapshot", "ingest_large_arrays"}


def library_queries():
    return {k: q for k, q in E.queries().items() if not k.startswith("op") and k != "pipeline"}


@pytest.mark.parametrize("name", sorted(set(library_queries()) - MATERIALISE))
def test_building_a_query_runs_no_job(spark, name):
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    for table in TABLES:                                   # footers are read by jobs of their own
        spark.read.parquet(f"{SF}/{table}.parquet")
    sc.setJobGroup(f"build-{name}", name)
    try:
        df = library_queries()[name](spark, SF)
        jobs = tracker.getJobIdsForGroup(f"build-{name}")
    finally:
        sc._jsc.clearJobGroup()
    plan = df._jdf.queryExecution().toString()
    tables = plan.count("FileScan parquet")
    assert len(jobs) <= tables + len(TABLES)               # one footer job for each table named, none besides
    assert "RoundRobinPartitioning" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["stats", "classify_counts", "row_tags", "audit", "category_scores"])
def test_documents_are_scanned_once(spark, name):
    plan = library_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") - plan.count("labels.parquet") == 1

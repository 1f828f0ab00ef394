"""Registered queries.

Each query takes ``(spark, sf_dir)``, reads the given tables through the record
view (``memlake.fixtures``) and returns a DataFrame of scalar columns (arrays
are joined to text, timestamps formatted, counts BIGINT, doubles rounded) so
that the DuckDB oracle text in ``ORACLE_SQL`` yields the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake import fixtures as fx
from memlake.functions.classify import classify_frame, extract_tags, category_scores
from memlake.functions.render import render_hit, render_line, render_short
from memlake.functions.text import context_line, fts_tokens
from memlake.functions.timefn import age_days, is_stale
from memlake.operators import audit as au
from memlake.operators import filters as fl
from memlake.operators import reports as rp
from memlake.operators import rules as rl
from memlake.operators.rules import Rules, exclude
from memlake.schema import validate
from memlake.session import checkpoint_dir
from memlake.sources import table as tb
from memlake.sources.arrays import array_elements, parse_array_elements
from memlake.sources.platforms import PLATFORMS
from memlake.sources.table import decode_legacy, upgrade_schema
from memlake.util import drop_materialized, materialize

AS_OF = fx.AS_OF
AS_OF_SQL = "TIMESTAMP '2024-07-20 00:00:00'"
STALE_CUTOFF_SQL = f"({AS_OF_SQL} - INTERVAL 180 DAY)"
# Parameters of the rule-filter queries.
CUSTOM_RULES = Rules(exclude_sensitive=True, exclude_tags=("src3", "de"),
                     exclude_categories=("project",), exclude_keywords=("thn", "Quell"))

EXPORT_PLATFORMS = ("chatgpt", "claude", "gemini")

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def _with(sql: str) -> str:
    return "WITH " + fx.RECORDS_SQL + "\n" + sql


def ts_str(col) -> F.Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def _rec(spark, sf_dir) -> DataFrame:
    return fx.records(spark, sf_dir)


# ----------------------------------------------------------------- counts ---

@register("visible_by_category", _with(
    "SELECT category, COUNT(*) AS n FROM records WHERE NOT sensitive GROUP BY category"))
def q_visible_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: default rules (F12), then count per category (A3)."""
    return rp.count_by_category(exclude(_rec(spark, sf_dir), Rules()))


FLAGSHIP = "visible_by_category"


@register("count_all", _with("SELECT COUNT(*) AS n FROM records"))
def q_count_all(spark, sf_dir):
    return rp.count_all(_rec(spark, sf_dir))


@register("count_by_source", _with("SELECT source, COUNT(*) AS n FROM records GROUP BY source"))
def q_count_by_source(spark, sf_dir):
    return rp.count_by_source(_rec(spark, sf_dir))


@register("count_by_category", _with("SELECT category, COUNT(*) AS n FROM records GROUP BY category"))
def q_count_by_category(spark, sf_dir):
    return rp.count_by_category(_rec(spark, sf_dir))


@register("stats", _with(f"""
SELECT 'total' AS metric, CAST(NULL AS VARCHAR) AS key, COUNT(*) AS value FROM records
UNION ALL SELECT 'sensitive', NULL, COUNT(*) FILTER (WHERE sensitive) FROM records
UNION ALL SELECT 'stale', NULL, COUNT(*) FILTER (WHERE created_at < {STALE_CUTOFF_SQL}) FROM records
UNION ALL SELECT 'by_source', source, COUNT(*) FROM records GROUP BY source
UNION ALL SELECT 'by_category', category, COUNT(*) FROM records GROUP BY category
UNION ALL SELECT 'rule', 'exclude_sensitive=true', CAST(1 AS BIGINT)"""))
def q_stats(spark, sf_dir):
    return rp.stats(_rec(spark, sf_dir), AS_OF, Rules())


@register("missing_categories", _with("""
SELECT k.category, CAST(k.cat_order AS BIGINT) AS cat_order
FROM (VALUES ('professional', 0), ('personal', 1), ('preference', 2), ('project', 3),
             ('relationship', 4)) k(category, cat_order)
WHERE k.category NOT IN (SELECT DISTINCT category FROM records)"""))
def q_missing_categories(spark, sf_dir):
    out = rp.missing_categories(_rec(spark, sf_dir))
    return out.select("category", F.col("cat_order").cast("bigint"))


# ---------------------------------------------------------------- filters ---

_LIST_SQL = "SELECT id, source, category, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM records"


def _list(df: DataFrame) -> DataFrame:
    return df.select("id", "source", "category", ts_str("created_at").alias("created_at"))


@register("by_category", _with(_LIST_SQL + " WHERE category = 'personal'"))
def q_by_category(spark, sf_dir):
    return _list(fl.by_category(_rec(spark, sf_dir), "personal"))


@register("by_source", _with(_LIST_SQL + " WHERE source = 'claude'"))
def q_by_source(spark, sf_dir):
    return _list(fl.by_source(_rec(spark, sf_dir), "claude"))


@register("sensitive_rows", _with(_LIST_SQL + " WHERE sensitive"))
def q_sensitive(spark, sf_dir):
    return _list(fl.sensitive(_rec(spark, sf_dir)))


@register("stale_rows", _with(f"""
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000) AS BIGINT) AS age_days
FROM records WHERE created_at < {STALE_CUTOFF_SQL}"""))
def q_stale(spark, sf_dir):
    return fl.stale(_rec(spark, sf_dir), AS_OF).select(
        "id", ts_str("created_at").alias("created_at"), age_days(AS_OF).alias("age_days"))


@register("lookup_ids", _with("""
SELECT r.id, r.category FROM records r
WHERE r.id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)"""))
def q_lookup(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return fl.lookup(_rec(spark, sf_dir), ids).select("id", "category")


@register("id_exists", _with("""
SELECT k.id, k.id IN (SELECT id FROM records) AS "exists"
FROM (SELECT DISTINCT CAST(conv_id * 13 AS VARCHAR) AS id FROM conversations) k"""))
def q_id_exists(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 13).cast("string").alias("id"))
    return fl.id_exists(_rec(spark, sf_dir), ids)


@register("content_exists", _with("""
SELECT k.content_key, k.content_key IN (SELECT sha256(content) FROM records) AS "exists"
FROM (SELECT DISTINCT sha256(text) AS content_key FROM (
        SELECT text FROM conversations
        UNION ALL SELECT d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id)) k"""))
def q_content_exists(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations").select(F.col("text").alias("content"))
    lab = fx.table(spark, sf_dir, "labels").select("doc_id")
    docs = fx.table(spark, sf_dir, "documents").join(lab, "doc_id").select(F.col("text").alias("content"))
    return fl.content_exists(_rec(spark, sf_dir), conv.unionByName(docs)).select("content_key", "exists")


def _rules_sql(r: Rules) -> str:
    preds = []
    if r.exclude_sensitive:
        preds.append("sensitive")
    if r.exclude_categories:
        preds.append("category IN (" + ", ".join(f"'{c}'" for c in r.exclude_categories) + ")")
    if r.exclude_tags:
        preds.append("len(list_intersect(tags, [" + ", ".join(f"'{t}'" for t in r.exclude_tags) + "])) > 0")
    for k in r.exclude_keywords:
        preds.append(f"contains(lower(content), '{k.lower()}')")
    return " OR ".join(preds) if preds else "FALSE"


@register("exclude_rules", _with(
    f"SELECT id, category FROM records WHERE NOT ({_rules_sql(CUSTOM_RULES)})"))
def q_exclude(spark, sf_dir):
    return exclude(_rec(spark, sf_dir), CUSTOM_RULES).select("id", "category")


@register("page", _with(f"""
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  CAST(10 + row_number() OVER (ORDER BY created_at DESC, id) AS BIGINT) AS position
FROM (SELECT * FROM records ORDER BY created_at DESC, id LIMIT 20 OFFSET 10)"""))
def q_page(spark, sf_dir):
    p = fl.page(_rec(spark, sf_dir), limit=20, offset=10)
    return fl.with_position(p, start=11).select(
        "id", ts_str("created_at").alias("created_at"), F.col("position").cast("bigint"))


@register("visible_page", _with("""
SELECT id, category FROM records WHERE NOT sensitive ORDER BY created_at DESC, id LIMIT 20"""))
def q_visible_page(spark, sf_dir):
    rows, _ = fl.visible_page(_rec(spark, sf_dir), Rules(), limit=20, offset=0)
    return rows.select("id", "category")


@register("visible_total", _with("SELECT COUNT(*) AS total_visible FROM records WHERE NOT sensitive"))
def q_visible_total(spark, sf_dir):
    _, total = fl.visible_page(_rec(spark, sf_dir), Rules(), limit=20, offset=0)
    return total


@register("visible_category", _with(
    "SELECT id, category FROM records WHERE category = 'professional' AND NOT sensitive"))
def q_visible_category(spark, sf_dir):
    return fl.visible_category(_rec(spark, sf_dir), "professional", Rules()).select("id", "category")


# ------------------------------------------------------------------ audit ---

def _audit_sql_cases() -> str:
    parts = []
    for label, pat in au.AUDIT_PATTERNS:
        p = pat.replace("'", "''")
        parts.append(f"SELECT id, '{label}' AS label, sensitive FROM records "
                     f"WHERE regexp_matches(content, '{p}')")
    return "\nUNION ALL ".join(parts)


@register("audit", _with(_audit_sql_cases()))
def q_audit(spark, sf_dir):
    return au.audit(_rec(spark, sf_dir)).select("id", "label", "sensitive")


@register("audit_summary", _with(f"""
, issues AS ({_audit_sql_cases()})
SELECT 'rows_scanned' AS metric, CAST(NULL AS VARCHAR) AS key, COUNT(*) AS value FROM records
UNION ALL SELECT 'issues', NULL, COUNT(*) FROM issues
UNION ALL SELECT 'by_label', label, COUNT(*) FROM issues GROUP BY label
UNION ALL SELECT 'by_sensitive', CAST(sensitive AS VARCHAR), COUNT(*) FROM issues GROUP BY sensitive"""))
def q_audit_summary(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return au.audit_summary(au.audit(rec), rec)


# ------------------------------------------------------ classify and tags ---

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _classify_sql(spec) -> str:
    scores = []
    for cat, kws in spec.category_rules:
        terms = " + ".join(f"CASE WHEN contains(lower(content), {_sql_str(k)}) THEN 1 ELSE 0 END" for k in kws)
        scores.append((cat, f"({terms})"))
    best = "greatest(" + ", ".join(s for _, s in scores) + ")"
    case = f"CASE WHEN {best} <= 0 THEN '{spec.default_category}'"
    for cat, s in scores:
        case += f" WHEN {s} = {best} THEN '{cat}'"
    return case + f" ELSE '{spec.default_category}' END"


def _tags_sql(spec) -> str:
    hits = ", ".join(f"CASE WHEN contains(lower(content), {_sql_str(k.lower())}) THEN {_sql_str(t)} END"
                     for k, t in spec.tag_map)
    arr = f"list_filter([{hits}], lambda x: x IS NOT NULL)"
    distinct = f"list_filter({arr}, lambda x, i: list_position({arr}, x) = i)"
    return f"{distinct}[1:{spec.max_tags}]"


@register("classify_counts", _with("\nUNION ALL ".join(
    f"SELECT '{name}' AS platform, {_classify_sql(spec)} AS category, COUNT(*) AS n "
    f"FROM records GROUP BY 2" for name, spec in PLATFORMS.items() if name in ("chatgpt", "claude", "gemini"))))
def q_classify_counts(spark, sf_dir):
    # All platforms in one scan: their scores are projected side by side, then each row gives one row a platform.
    rec = _rec(spark, sf_dir).select("content")
    for name in EXPORT_PLATFORMS:
        rec = classify_frame(rec, PLATFORMS[name], out=f"c_{name}")
    each = F.array(*[F.struct(F.lit(n).alias("platform"), F.col(f"c_{n}").alias("category")) for n in EXPORT_PLATFORMS])
    return rec.select(F.inline(each)).groupBy("platform", "category").agg(F.count(F.lit(1)).alias("n"))


@register("category_scores", _with(
    "SELECT id, " + ", ".join(
        "(" + " + ".join(f"CASE WHEN contains(lower(content), {_sql_str(k)}) THEN 1 ELSE 0 END" for k in kws)
        + f") AS {cat}" for cat, kws in PLATFORMS["claude"].category_rules) + " FROM records"))
def q_category_scores(spark, sf_dir):
    s = category_scores("content", "claude")
    cats = [c for c, _ in PLATFORMS["claude"].category_rules]
    return _rec(spark, sf_dir).select("id", *[s[c].cast("bigint").alias(c) for c in cats])


@register("row_tags", _with("\nUNION ALL ".join(
    f"SELECT '{name}' AS platform, id, array_to_string({_tags_sql(spec)}, ',') AS tags FROM records"
    for name, spec in PLATFORMS.items() if name in ("chatgpt", "claude", "gemini"))))
def q_row_tags(spark, sf_dir):
    each = F.array(*[F.struct(F.lit(n).alias("platform"), F.array_join(extract_tags("content", PLATFORMS[n]), ",").alias("tags"))
                     for n in EXPORT_PLATFORMS])
    return _rec(spark, sf_dir).select("id", F.inline(each))


# ---------------------------------------------------- lines, ages, render ---

@register("context_lines", _with("SELECT id, '[' || upper(category) || '] ' || content AS line FROM records"))
def q_context_lines(spark, sf_dir):
    return _rec(spark, sf_dir).select("id", context_line().alias("line"))


@register("ages", _with(f"""
SELECT id,
  CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000) AS BIGINT) AS age_days,
  floor((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000) > 180 AS is_stale
FROM records"""))
def q_ages(spark, sf_dir):
    return _rec(spark, sf_dir).select("id", age_days(AS_OF).alias("age_days"),
                                      is_stale(AS_OF, 180).alias("is_stale"))


@register("render_page", _with("""
SELECT id, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS VARCHAR) || '. [' || upper(category) || '] '
  || content || CASE WHEN sensitive THEN ' [SENSITIVE]' ELSE '' END
  || chr(10) || '   Source: ' || source || ' | Confidence: '
  || CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '%'
  || ' | Tags: ' || CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'none' END
  || ' | ID: ' || id AS line
FROM (SELECT * FROM records WHERE NOT sensitive ORDER BY created_at DESC, id LIMIT 20)"""))
def q_render_page(spark, sf_dir):
    rows, _ = fl.visible_page(_rec(spark, sf_dir), Rules(), limit=20, offset=0)
    numbered = fl.with_position(rows, start=1)
    return numbered.select("id", render_line(F.col("position")).alias("line"))


# -------------------------------------------------------- near duplicates ---

from memlake.operators import dedup as dd  # noqa: E402
from memlake.functions.text import PY_WHITESPACE  # noqa: E402

THRESHOLD = 0.75

_WORDSETS_SQL = f"""
, ws AS (
  SELECT id, created_at,
    list_distinct(list_filter(regexp_split_to_array(lower(content), '[{PY_WHITESPACE}]+'),
                              lambda x: x <> '')) AS words
  FROM records)
, wk AS (SELECT id, created_at, words, sha256(array_to_string(list_sort(words), ' ')) AS set_key
         FROM ws WHERE len(words) > 0)
, grp AS (SELECT set_key, arg_max(id, created_at) AS rep_id, max(created_at) AS rep_created_at,
                 COUNT(*) AS copies, any_value(words) AS words, len(any_value(words)) AS n
          FROM wk GROUP BY set_key)
, tok AS (SELECT set_key, n, unnest(words) AS w FROM grp)
, shared AS (
  SELECT a.set_key AS ka, b.set_key AS kb, any_value(a.n) AS na, any_value(b.n) AS nb, COUNT(*) AS inter
  FROM tok a JOIN tok b ON a.w = b.w AND a.set_key < b.set_key
   AND least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9
  GROUP BY a.set_key, b.set_key)
, pairs AS (
  SELECT s.inter / (s.na + s.nb - s.inter) AS jaccard, ga.rep_id AS ra, gb.rep_id AS rb,
         ga.rep_created_at AS ta, gb.rep_created_at AS tb, ga.copies AS ca, gb.copies AS cb
  FROM shared s JOIN grp ga ON ga.set_key = s.ka JOIN grp gb ON gb.set_key = s.kb
  WHERE s.inter / (s.na + s.nb - s.inter) >= {THRESHOLD})
, np AS (
  SELECT CASE WHEN ta > tb OR (ta = tb AND ra < rb) THEN ra ELSE rb END AS id_a,
         CASE WHEN ta > tb OR (ta = tb AND ra < rb) THEN rb ELSE ra END AS id_b,
         round(jaccard, 6) AS jaccard,
         CASE WHEN ta > tb OR (ta = tb AND ra < rb) THEN ca ELSE cb END AS copies_a,
         CASE WHEN ta > tb OR (ta = tb AND ra < rb) THEN cb ELSE ca END AS copies_b
  FROM pairs)"""


@register("near_duplicates", _with(_WORDSETS_SQL + "\nSELECT * FROM np"))
def q_near_duplicates(spark, sf_dir):
    p = dd.near_duplicates(_rec(spark, sf_dir), THRESHOLD)
    return p.select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"), "copies_a", "copies_b")


@register("duplicate_copies", _with(_WORDSETS_SQL + """
SELECT g.rep_id, w.id FROM wk w JOIN grp g ON w.set_key = g.set_key
WHERE g.copies > 1 AND w.id <> g.rep_id"""))
def q_duplicate_copies(spark, sf_dir):
    return dd.duplicate_copies(_rec(spark, sf_dir))


_PAIRS_TOTAL_SQL = """
, total AS (SELECT CAST(COALESCE((SELECT SUM(copies_a * copies_b) FROM np), 0)
                 + COALESCE((SELECT SUM(copies * (copies - 1) // 2) FROM grp), 0) AS BIGINT) AS pairs)"""


@register("near_duplicate_pairs", _with(_WORDSETS_SQL + _PAIRS_TOTAL_SQL + "\nSELECT pairs FROM total"))
def q_near_duplicate_pairs(spark, sf_dir):
    return dd.pair_count(_rec(spark, sf_dir), THRESHOLD).select(F.col("pairs").cast("bigint"))


@register("health", _with(_WORDSETS_SQL + _PAIRS_TOTAL_SQL + f"""
, base AS (
  SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE created_at < {STALE_CUTOFF_SQL}) AS stale,
         COUNT(*) FILTER (WHERE sensitive) AS sensitive,
         5 - COUNT(DISTINCT category) FILTER (WHERE category IN
             ('professional', 'personal', 'preference', 'project', 'relationship')) AS missing
  FROM records)
, sc AS (
  SELECT b.total, b.stale, b.sensitive, t.pairs, CAST(b.missing AS BIGINT) AS missing,
    CAST(greatest(0, 100 - least(30, CAST(floor(b.stale / b.total * 100) AS BIGINT))
         - least(20, t.pairs * 5) - b.missing * 5) AS BIGINT) AS score
  FROM base b, total t WHERE b.total > 0)
SELECT total, stale, sensitive, pairs, missing, score,
  CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade,
  score < 70 AS review_tip
FROM sc"""))
def q_health(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    inputs = rp.health_inputs(rec, AS_OF, dd.pair_count(rec, THRESHOLD))
    return rp.health(inputs).select("total", "stale", "sensitive", "pairs", "missing", "score",
                                    "grade", "review_tip")


@register("stalest", _with(f"""
SELECT id, CAST(row_number() OVER (ORDER BY created_at, id) AS BIGINT) AS rank,
  CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000) AS BIGINT) AS age_days
FROM records WHERE created_at < {STALE_CUTOFF_SQL}
QUALIFY row_number() OVER (ORDER BY created_at, id) <= 5"""))
def q_stalest(spark, sf_dir):
    return rp.stalest(_rec(spark, sf_dir), AS_OF, n=5).select(
        "id", F.col("rank").cast("bigint"), "age_days")


# ------------------------------------------------- keyword search, prompts ---

from memlake.operators import keyword as kw  # noqa: E402
from memlake.operators import packs as pk  # noqa: E402

_KW_SQL = f"""
, q AS (SELECT item_id AS query_id, text AS query FROM benchmark)
, qw AS (SELECT query_id, word, COUNT(*) AS repeats FROM (
    SELECT query_id, unnest(regexp_split_to_array(lower(query), '[{PY_WHITESPACE}]+')) AS word FROM q)
  WHERE word <> '' GROUP BY ALL)
, d AS (SELECT id, created_at, lower(content || ' ' || array_to_string(tags, ' ')) AS txt FROM records)
, hits AS (SELECT qw.query_id, d.id, d.created_at, CAST(SUM(qw.repeats) AS BIGINT) AS score
           FROM qw JOIN d ON contains(d.txt, qw.word) GROUP BY ALL)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS rank
             FROM hits)"""


@register("keyword_search", _with(_KW_SQL + """
SELECT query_id, id, score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 5"""))
def q_keyword_search(spark, sf_dir):
    res = kw.keyword_search(_rec(spark, sf_dir), fx.queries_table(spark, sf_dir), limit=5)
    return res.select("query_id", "id", "score", F.col("rank").cast("bigint"))


@register("prompts", _with(_KW_SQL + """
, vis AS (SELECT r.query_id, r.rank, '[' || upper(x.category) || '] ' || x.content AS line
          FROM ranked r JOIN records x ON r.id = x.id WHERE r.rank <= 8 AND NOT x.sensitive)
, agg AS (SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS block FROM vis GROUP BY query_id)
SELECT q.query_id, CASE WHEN a.block IS NULL THEN q.query
  ELSE '## Personal Context' || chr(10) || a.block || chr(10) || chr(10) || '---' || chr(10) || chr(10) || q.query
  END AS prompt
FROM q LEFT JOIN agg a ON q.query_id = a.query_id"""))
def q_prompts(spark, sf_dir):
    return pk.prompts(_rec(spark, sf_dir), fx.queries_table(spark, sf_dir), Rules(), limit=8)


# Parameters of the pack queries (definitions, like rules, are settings).
PACK_DEFS = [
    ("coding", "professional, project", "python,AI", "src3", "Work context"),
    ("life", "personal,preference,relationship,personal", "", "de, fr", ""),
]


def _packs(spark):
    defs = spark.createDataFrame(PACK_DEFS, "name string, categories string, tags string, "
                                            "exclude_tags string, description string")
    return pk.parse_pack_defs(defs)


_PACKS_SQL = """
, packs(name, cat_list, ex_list, description) AS (VALUES
    ('coding', ['professional', 'project'], ['src3'], 'Work context'),
    ('life', ['personal', 'preference', 'relationship', 'personal'], ['de', 'fr'], ''))
, pc AS (SELECT name AS pack, ex_list, unnest(cat_list) AS category,
                generate_subscripts(cat_list, 1) - 1 AS cat_pos FROM packs)
, mem AS (SELECT pc.pack, CAST(pc.cat_pos AS BIGINT) AS cat_pos, r.* FROM pc JOIN records r
          ON r.category = pc.category
          WHERE NOT r.sensitive AND len(list_intersect(r.tags, pc.ex_list)) = 0)"""


@register("pack_members", _with(_PACKS_SQL + """
SELECT pack, cat_pos, id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM mem"""))
def q_pack_members(spark, sf_dir):
    m = pk.pack_members(_rec(spark, sf_dir), _packs(spark), Rules())
    return m.select("pack", F.col("cat_pos").cast("bigint"), "id", ts_str("created_at").alias("created_at"))


@register("pack_lines", _with(_PACKS_SQL + """
, present AS (SELECT DISTINCT pack FROM mem)
SELECT pack, 0 AS part, '# ' || pack AS line FROM present
UNION ALL SELECT p.name, 1, '# ' || p.description FROM packs p JOIN present x ON p.name = x.pack
  WHERE p.description <> ''
UNION ALL SELECT pack, 1, '' FROM present
UNION ALL SELECT pack, 2, '[' || upper(category) || '] ' || content FROM mem"""))
def q_pack_lines(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    packs = _packs(spark)
    lines = pk.pack_lines(pk.pack_members(rec, packs, Rules()), packs)
    return lines.select("pack", F.col("part").cast("int"), "line")


# ------------------------------------------------------- full-text search ---

from memlake.functions.stemming import stem_sql  # noqa: E402
from memlake.operators import search as se  # noqa: E402

_U = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_L = "abcdefghijklmnopqrstuvwxyz"
_FTS_SPLIT = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def _fts_tokens_sql(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array(translate({expr}, '{_U}', '{_L}'), '{_FTS_SPLIT}'), "
            f"lambda x: x <> '')")


_BM25_SQL = f"""
, tk AS (SELECT id, unnest({_fts_tokens_sql('content')} || {_fts_tokens_sql("array_to_string(tags, ' ')")}) AS term
         FROM records)
, post AS (SELECT term, id, COUNT(*) AS tf FROM tk GROUP BY term, id)
, lens AS (SELECT r.id, COALESCE(c.dl, 0) AS dl FROM records r
           LEFT JOIN (SELECT id, COUNT(*) AS dl FROM tk GROUP BY id) c ON r.id = c.id)
, st AS (SELECT COUNT(*) AS n_rows, SUM(dl) / COUNT(*) AS avgdl FROM lens)
, tstat AS (SELECT term, COUNT(*) AS n_t FROM post GROUP BY term)
, qt AS (SELECT query_id, term, COUNT(*) AS repeats FROM (
          SELECT item_id AS query_id, unnest({_fts_tokens_sql('text')}) AS term FROM benchmark {{qfilter}})
         GROUP BY ALL)
, need AS (SELECT query_id, COUNT(*) AS n_terms FROM qt GROUP BY query_id)
, m AS (SELECT qt.query_id, p.id, qt.term, qt.repeats, p.tf, ts.n_t FROM qt JOIN post p ON p.term = qt.term
        JOIN tstat ts ON ts.term = qt.term)
, sc AS (SELECT m.query_id, m.id, COUNT(*) AS n_hit,
           -- left fold in term order: equal rows get equal scores on every run
           list_reduce(list(m.repeats * greatest(ln((st.n_rows - m.n_t + 0.5) / (m.n_t + 0.5)), 1e-6)
               * (m.tf * 2.2) / (m.tf + 1.2 * (0.25 + 0.75 * l.dl / st.avgdl)) ORDER BY m.term),
               lambda a, b: a + b) AS score
         FROM m JOIN lens l ON l.id = m.id CROSS JOIN st GROUP BY m.query_id, m.id)
, full_hits AS (SELECT sc.query_id, sc.id, sc.score, r.created_at, r.sensitive
                FROM sc JOIN need n ON n.query_id = sc.query_id AND sc.n_hit = n.n_terms
                JOIN records r ON r.id = sc.id)"""


@register("search_bm25", _with(_BM25_SQL.replace("{qfilter}", "") + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS rank
         FROM full_hits)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 5"""))
def q_search_bm25(spark, sf_dir):
    res = se.search(_rec(spark, sf_dir), fx.queries_table(spark, sf_dir), limit=5, stem=False)
    return res.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


_STEMMED_SQL = _BM25_SQL.replace("{qfilter}", "").replace(", tk AS (", ", tk0 AS (").replace(
    ", post AS (", f""", asked AS (SELECT item_id AS query_id, unnest({_fts_tokens_sql('text')}) AS term FROM benchmark)
, stemmed AS MATERIALIZED ({stem_sql("SELECT DISTINCT term FROM (SELECT term FROM tk0 UNION ALL SELECT term FROM asked)")})
, tk AS (SELECT id, stem AS term FROM tk0 JOIN stemmed USING (term))
, post AS (""", 1).replace(f"SELECT item_id AS query_id, unnest({_fts_tokens_sql('text')}) AS term FROM benchmark )",
                           "SELECT query_id, stem AS term FROM asked JOIN stemmed USING (term))")


@register("search_bm25_stemmed", _with(_STEMMED_SQL + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS rank
         FROM full_hits)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 5"""))
def q_search_bm25_stemmed(spark, sf_dir):
    res = se.search(_rec(spark, sf_dir), fx.queries_table(spark, sf_dir), limit=5, stem=True)
    return res.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@register("relevant", _with(_BM25_SQL.replace("{qfilter}", "") + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS rank
         FROM full_hits WHERE NOT sensitive)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 5"""))
def q_relevant(spark, sf_dir):
    res = se.relevant(_rec(spark, sf_dir), fx.queries_table(spark, sf_dir), Rules(), limit=5, stem=False)
    return res.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


_AMENDED_SQL = _BM25_SQL.replace("{qfilter}", "").replace("FROM records", "FROM amended").replace("JOIN records", "JOIN amended")


@register("index_after_changes", _with("""
, turned AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS id, text AS content, CAST([] AS VARCHAR[]) AS tags,
               TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL '1' SECOND AS created_at, role <> 'user' AS sensitive FROM conversations)
, amended AS (SELECT id, CASE WHEN sensitive THEN 'changed ' || content ELSE content END AS content, tags, created_at, sensitive FROM records
              WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0 AND toxic = 0)
              UNION ALL SELECT id, content, tags, created_at, sensitive FROM turned)""" + _AMENDED_SQL + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS rank FROM full_hits)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 5"""))
def q_index_after_changes(spark, sf_dir):
    """Q3 upkeep: rows of low quality leave the index, sensitive rows change
    their text, conversation turns come in; then every benchmark search."""
    rec = _rec(spark, sf_dir)
    low = fx.table(spark, sf_dir, "labels").where("quality = 0 and toxic = 0").select(F.col("doc_id").cast("string").alias("id"))
    changed = rec.where("sensitive").join(low, "id", "left_anti").withColumn("content", F.concat(F.lit("changed "), "content"))
    added = changed.select("id", "content", "tags", "created_at").unionByName(
        owned_records(spark, sf_dir).select("id", "content", "tags", "created_at"))
    index = se.build_index(rec, stem=False)
    amended = se.amend_index(index, added, low.unionByName(changed.select("id")))
    res = se.search(None, fx.queries_table(spark, sf_dir), limit=5, index=amended)
    index.drop()
    return res.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@register("index_stats", _with(_BM25_SQL.replace("{qfilter}", "") + """
SELECT CAST(n_rows AS BIGINT) AS n_rows, round(avgdl, 6) AS avgdl,
       (SELECT COUNT(*) FROM tstat) AS n_terms, (SELECT COUNT(*) FROM post) AS n_postings FROM st"""))
def q_index_stats(spark, sf_dir):
    idx = se.build_index(_rec(spark, sf_dir), stem=False)
    return idx.stats.select(
        F.col("n_rows").cast("bigint"), F.round("avgdl", 6).alias("avgdl"),
        idx.terms.agg(F.count(F.lit(1))).scalar().alias("n_terms"),
        idx.postings.agg(F.count(F.lit(1))).scalar().alias("n_postings"))


def routed_queries(spark, sf_dir) -> DataFrame:
    """Benchmark texts as typed (punctuation sends them to the keyword route)
    and the same texts with punctuation replaced by spaces (ranked route)."""
    b = fx.table(spark, sf_dir, "benchmark")
    raw = b.select((F.col("item_id") * 2).alias("query_id"), F.col("text").alias("query"))
    clean = b.select((F.col("item_id") * 2 + 1).alias("query_id"),
                     F.regexp_replace("text", r"[^\p{L}\p{N}\s]", " ").alias("query"))
    return raw.unionByName(clean)


_ROUTE_Q_SQL = """
, rq AS (SELECT item_id * 2 AS query_id, text AS query FROM benchmark
         UNION ALL SELECT item_id * 2 + 1, regexp_replace(text, '[^\\pL\\pN\\s]', ' ', 'g') FROM benchmark)
, rw AS (SELECT *, string_split(trim(query), ' ') AS w FROM rq)
, routed AS (SELECT query_id, query,
    CASE WHEN regexp_full_match(query, '""" + se.VALID_QUERY.replace("'", "''") + """')
          AND len(list_intersect(regexp_split_to_array(trim(query), '\\s+'), ['OR', 'NOT', 'NEAR'])) = 0
          AND regexp_split_to_array(trim(query), '\\s+')[1] <> 'AND'
          AND regexp_split_to_array(trim(query), '\\s+')[-1] <> 'AND'
         THEN 'ranked' ELSE 'keyword' END AS mode FROM rq)"""


@register("route_queries", _with(_ROUTE_Q_SQL + "\nSELECT query_id, mode FROM routed"))
def q_route_queries(spark, sf_dir):
    return se.route_queries(routed_queries(spark, sf_dir)).select("query_id", "mode")


_ROUTED_SQL = (_ROUTE_Q_SQL + _BM25_SQL.replace(
    "SELECT item_id AS query_id, unnest(" + _fts_tokens_sql('text') + ") AS term FROM benchmark {qfilter}",
    "SELECT query_id, unnest(" + _fts_tokens_sql('query') + ") AS term FROM routed WHERE mode = 'ranked'")
    + _KW_SQL.replace(", q AS (SELECT item_id AS query_id, text AS query FROM benchmark)",
                      ", q AS (SELECT query_id, query FROM routed WHERE mode = 'keyword')")
    .replace(", ranked AS", ", kranked AS") + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS rank
         FROM full_hits)
SELECT query_id, 'ranked' AS mode, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 5
UNION ALL
SELECT query_id, 'keyword', id, CAST(score AS DOUBLE), CAST(rank AS BIGINT) FROM kranked WHERE rank <= 5""")


@register("routed_search", _with(_ROUTED_SQL))
def q_routed_search(spark, sf_dir):
    res = se.routed_search(_rec(spark, sf_dir), routed_queries(spark, sf_dir), limit=5, stem=False)
    return res.select("query_id", "mode", "id", F.round("score", 6).alias("score"),
                      F.col("rank").cast("bigint"))


# ----------------------------------------------------------------- import ---

from memlake.operators import ingest as ig  # noqa: E402


@register("import_plan", _with("""
, inc AS (SELECT id, content, doc_pos FROM (SELECT r.*, CAST(r.id AS BIGINT) AS doc_pos FROM records r))
, firsts AS (SELECT sha256(content) AS ck, min(doc_pos) AS first_pos FROM inc GROUP BY 1)
, stored AS (SELECT DISTINCT sha256(text) AS ck FROM conversations)
SELECT i.id, CASE WHEN s.ck IS NULL AND i.doc_pos = f.first_pos THEN 'insert' ELSE 'duplicate' END AS action
FROM inc i JOIN firsts f ON f.ck = sha256(i.content) LEFT JOIN stored s ON s.ck = sha256(i.content)"""))
def q_import_plan(spark, sf_dir):
    """Document records imported into a table holding the conversation turns."""
    conv = fx.conversation_records(spark, sf_dir).withColumn("category", F.lit("personal"))
    table = ig.manual_records(conv, AS_OF)
    incoming = (_rec(spark, sf_dir).withColumn("file", F.lit("documents"))
                .withColumn("pos", F.col("id").cast("bigint")))
    return ig.plan_import(table, incoming).select("id", "action")


@register("import_report", _with("""
, inc AS (SELECT id, content, source, CAST(id AS BIGINT) AS doc_pos FROM records)
, firsts AS (SELECT sha256(content) AS ck, min(doc_pos) AS first_pos FROM inc GROUP BY 1)
, stored AS (SELECT DISTINCT sha256(text) AS ck FROM conversations)
, act AS (SELECT i.source, CASE WHEN s.ck IS NULL AND i.doc_pos = f.first_pos THEN 'added' ELSE 'duplicates' END AS a
          FROM inc i JOIN firsts f ON f.ck = sha256(i.content) LEFT JOIN stored s ON s.ck = sha256(i.content))
, newt AS (SELECT 'manual' AS source FROM conversations UNION ALL SELECT source FROM act WHERE a = 'added')
SELECT a AS metric, CAST(NULL AS VARCHAR) AS key, COUNT(*) AS value FROM act GROUP BY a
UNION ALL SELECT 'total', NULL, COUNT(*) FROM newt
UNION ALL SELECT 'by_source', source, COUNT(*) FROM newt GROUP BY source"""))
def q_import_report(spark, sf_dir):
    conv = fx.conversation_records(spark, sf_dir).withColumn("category", F.lit("personal"))
    table = ig.manual_records(conv, AS_OF)
    incoming = (_rec(spark, sf_dir).withColumn("file", F.lit("documents"))
                .withColumn("pos", F.col("id").cast("bigint")))
    _, report = ig.import_records(table, incoming)
    return report


# ------------------------------------------------------------ bulk changes ---

from memlake.operators import changes as chg  # noqa: E402

CHANGE_AS_OF_SQL = "TIMESTAMP '2024-07-20 00:00:00'"


@register("mark_sensitive", _with("""
, ch AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality = 0 AS s FROM labels)
, new AS (SELECT r.id, COALESCE(ch.s, r.sensitive) AS sensitive,
             CASE WHEN ch.id IS NULL THEN r.updated_at ELSE """ + CHANGE_AS_OF_SQL + """ END AS updated_at
          FROM records r LEFT JOIN ch ON r.id = ch.id)
SELECT id, sensitive, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM new"""))
def q_mark_sensitive(spark, sf_dir):
    """M3: every labelled row's flag set from its label (quality 0 -> sensitive)."""
    ch = fx.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 0).alias("sensitive"))
    new, _ = chg.apply_sensitive(_rec(spark, sf_dir), ch, AS_OF)
    return new.select("id", "sensitive", ts_str("updated_at").alias("updated_at"))


@register("change_report", _with("""
, ids AS (SELECT DISTINCT CAST(conv_id * 13 AS VARCHAR) AS id FROM conversations)
SELECT 'matched' AS metric, COUNT(*) AS value FROM ids WHERE id IN (SELECT id FROM records)
UNION ALL SELECT 'not_found', COUNT(*) FROM ids WHERE id NOT IN (SELECT id FROM records)
UNION ALL SELECT 'rejected', 0"""))
def q_change_report(spark, sf_dir):
    """M1 report: updates keyed by conversation ids (some exist, some do not)."""
    conv = fx.table(spark, sf_dir, "conversations")
    ch = conv.select((F.col("conv_id") * 13).cast("string").alias("id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    _, _, rep = chg.apply_updates(_rec(spark, sf_dir), ch, AS_OF)
    return rep


@register("apply_updates", _with("""
, ch AS (SELECT CAST(conv_id * 13 AS VARCHAR) AS id, arg_max(text, turn) AS content FROM conversations GROUP BY conv_id)
SELECT r.id, sha256(COALESCE(ch.content, r.content)) AS content_key, r.category,
       strftime(CASE WHEN ch.id IS NULL THEN r.updated_at ELSE """ + CHANGE_AS_OF_SQL + """ END,
                '%Y-%m-%d %H:%M:%S') AS updated_at
FROM records r LEFT JOIN ch ON r.id = ch.id"""))
def q_apply_updates(spark, sf_dir):
    """M1: the turns of each conversation replace, one after another, the
    content of the record with id conv_id*13 (where it exists)."""
    conv = fx.table(spark, sf_dir, "conversations")
    ch = conv.select((F.col("conv_id") * 13).cast("string").alias("id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    new, _, _ = chg.apply_updates(_rec(spark, sf_dir), ch, AS_OF)
    return new.select("id", F.sha2("content", 256).alias("content_key"), "category",
                      ts_str("updated_at").alias("updated_at"))


@register("delete_flagged", _with("""
SELECT id, category FROM records
WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"""))
def q_delete_flagged(spark, sf_dir):
    """M4: delete every row its label marks toxic."""
    ids = fx.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    new, _ = chg.delete_ids(_rec(spark, sf_dir), ids)
    return new.select("id", "category")


@register("health_examples", _with(_WORDSETS_SQL + """
SELECT np.id_a, np.id_b, round(np.jaccard, 6) AS jaccard,
  CAST(row_number() OVER (ORDER BY r.created_at DESC, np.id_a, np.id_b) AS BIGINT) AS rank
FROM np JOIN records r ON r.id = np.id_a
QUALIFY row_number() OVER (ORDER BY r.created_at DESC, np.id_a, np.id_b) <= 3"""))
def q_health_examples(spark, sf_dir):
    """The three newest near-duplicate pairs."""
    rec = _rec(spark, sf_dir)
    ex = dd.newest_pairs(rec, THRESHOLD, n=3)
    return ex.select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"), F.col("rank").cast("bigint"))


_PHRASE_SQL = f"""
, fld AS (SELECT id, {_fts_tokens_sql('content')} AS toks FROM records
          UNION ALL SELECT id, {_fts_tokens_sql("array_to_string(tags, ' ')")} FROM records)
, pos AS (SELECT id, toks, generate_subscripts(toks, 1) AS p FROM fld)
, ph AS (SELECT item_id AS query_id, {_fts_tokens_sql('text')} AS pt FROM benchmark)
, occ AS (SELECT ph.query_id, pos.id, COUNT(*) AS tf FROM ph JOIN pos
            ON pos.toks[pos.p] = ph.pt[1] AND pos.toks[pos.p:pos.p + len(ph.pt) - 1] = ph.pt
          WHERE len(ph.pt) > 0 GROUP BY ALL)
, lens2 AS (SELECT r.id, r.created_at, COALESCE(c.dl, 0) AS dl FROM records r LEFT JOIN
            (SELECT id, SUM(len(toks)) AS dl FROM fld GROUP BY id) c ON r.id = c.id)
, st2 AS (SELECT COUNT(*) AS n_rows, SUM(dl) / COUNT(*) AS avgdl FROM lens2)
, nph AS (SELECT query_id, COUNT(*) AS n_t FROM occ GROUP BY query_id)
, sc2 AS (SELECT o.query_id, o.id, l.created_at,
            greatest(ln((st2.n_rows - n.n_t + 0.5) / (n.n_t + 0.5)), 1e-6)
            * (o.tf * 2.2) / (o.tf + 1.2 * (0.25 + 0.75 * l.dl / st2.avgdl)) AS score
          FROM occ o JOIN nph n ON n.query_id = o.query_id JOIN lens2 l ON l.id = o.id CROSS JOIN st2)
, rk2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS rank
          FROM sc2)"""


@register("phrase_search", _with(_PHRASE_SQL + """
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM rk2 WHERE rank <= 5"""))
def q_phrase_search(spark, sf_dir):
    """Passage search: each benchmark text as one phrase (documents quote them)."""
    q = fx.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array(F.col("text")).alias("phrases"))
    res = se.phrase_search(_rec(spark, sf_dir), q, limit=5, stem=False)
    return res.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


# ---------------------------------------------------------- export ingest ---

from memlake.sources import exports as ex  # noqa: E402


def conversation_exports(spark, sf_dir) -> DataFrame:
    """Each conversation turn as one claude-style export document: user turns
    as a bare string, assistant turns as ``{content}``, system turns as
    ``{memory, created_at}`` with a time derived from the turn."""
    c = fx.table(spark, sf_dir, "conversations")
    ts = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    doc = (F.when(F.col("role") == "user", F.to_json(F.array(F.col("text"))))
           .when(F.col("role") == "assistant", F.to_json(F.array(F.struct(F.col("text").alias("content")))))
           .otherwise(F.to_json(F.array(F.struct(F.col("text").alias("memory"), ts.alias("created_at"))))))
    return c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file"),
                    doc.alias("value"))


_CONV_STRIP = f"regexp_replace(text, '^[{PY_WHITESPACE}]+|[{PY_WHITESPACE}]+$', '', 'g')"
_CLAUDE_CASE = _classify_sql(PLATFORMS["claude"]).replace("content", "c")


@register("ingest_conversations", f"""
WITH t AS (SELECT {_CONV_STRIP} AS c FROM conversations)
, cls AS (SELECT {_CLAUDE_CASE} AS category FROM t WHERE c <> '')
SELECT 'parsed' AS metric, CAST(NULL AS VARCHAR) AS key, COUNT(*) AS value FROM t WHERE c <> ''
UNION ALL SELECT 'skipped', NULL, COUNT(*) FROM t WHERE c = ''
UNION ALL SELECT 'category', category, COUNT(*) FROM cls GROUP BY category""")
def q_ingest_conversations(spark, sf_dir):
    """S1-S7 on export documents derived from the conversation turns."""
    rows = ex.parse_document_rows(conversation_exports(spark, sf_dir), "claude", AS_OF)
    return ex.ingest_summary(rows).select("metric", "key", "value")


@register("ingest_records", f"""
SELECT sha256('claude|' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '|0|' || {_CONV_STRIP})
         AS id,
       CASE WHEN role = 'system'
            THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL '1' MINUTE, '%Y-%m-%d %H:%M:%S')
            ELSE '2024-07-20 00:00:00' END AS created_at,
       {_CLAUDE_CASE.replace('(c)', '(' + _CONV_STRIP + ')').replace('lower(c)', 'lower(' + _CONV_STRIP + ')')}
         AS category
FROM conversations WHERE {_CONV_STRIP} <> ''""")
def q_ingest_records(spark, sf_dir):
    """S1-S6 records (ids, parsed times, categories) from the same documents."""
    recs, _ = ex.parse_documents(conversation_exports(spark, sf_dir), "claude", AS_OF)
    return recs.select("id", ts_str("created_at").alias("created_at"), "category")


# ------------------------------------------------- structured and stemmed search ---

def structured_queries(spark, sf_dir) -> DataFrame:
    """Queries of every kind from the benchmark texts: the first word with
    alternatives and an excluded word, a three-word phrase, a prefix of four
    characters, and the same limited to one field."""
    b = fx.table(spark, sf_dir, "benchmark").select("item_id", fts_tokens("text").alias("w")).where(F.size("w") >= 6)
    none = F.array().cast("array<string>")

    def kind(n, all_terms=none, any_terms=none, none_terms=none, phrases=none, prefixes=none, field=None):
        return F.struct((F.col("item_id") * 6 + n).alias("query_id"), all_terms.alias("all_terms"), any_terms.alias("any_terms"),
                        none_terms.alias("none_terms"), phrases.alias("phrases"), prefixes.alias("prefixes"),
                        F.lit(field).cast("string").alias("field"))
    w = F.col("w")
    phrase = F.array(F.array_join(F.slice(w, 1, 3), " "))
    start = F.array(F.substring(w[4], 1, 4))
    return b.select(F.inline(F.array(
        kind(0, all_terms=F.slice(w, 1, 1), any_terms=F.slice(w, 2, 2), none_terms=F.slice(w, 4, 1)),
        kind(1, phrases=phrase), kind(2, prefixes=start), kind(3, any_terms=F.slice(w, 1, 4), none_terms=F.slice(w, 5, 2)),
        kind(4, all_terms=F.slice(w, 2, 1), prefixes=start, field="content"), kind(5, any_terms=F.array(F.lit("src3"), F.lit("en"), w[0]), field="tags"))))


_STRUCTURED_SQL = f"""
, fld AS (SELECT id, 'content' AS f, {_fts_tokens_sql('content')} AS toks FROM records
          UNION ALL SELECT id, 'tags', {_fts_tokens_sql("array_to_string(tags, ' ')")} FROM records)
, pos AS (SELECT id, f, toks, generate_subscripts(toks, 1) AS p FROM fld WHERE len(toks) > 0)
, lens3 AS (SELECT id, SUM(len(toks)) AS dl FROM fld GROUP BY id)
, st3 AS (SELECT COUNT(*) AS n_rows, SUM(dl) / COUNT(*) AS avgdl FROM lens3)
, bw AS (SELECT item_id, w FROM (SELECT item_id, {_fts_tokens_sql('text')} AS w FROM benchmark) WHERE len(w) >= 6)
, raw AS (
  SELECT item_id * 6 AS query_id, 'all' AS role, [w[1]] AS toks, FALSE AS prefix, NULL AS field FROM bw
  UNION ALL SELECT item_id * 6, 'any', [unnest(w[2:3])], FALSE, NULL FROM bw
  UNION ALL SELECT item_id * 6, 'none', [w[4]], FALSE, NULL FROM bw
  UNION ALL SELECT item_id * 6 + 1, 'all', w[1:3], FALSE, NULL FROM bw
  UNION ALL SELECT item_id * 6 + 2, 'all', [w[5][1:4]], TRUE, NULL FROM bw
  UNION ALL SELECT item_id * 6 + 3, 'any', [unnest(w[1:4])], FALSE, NULL FROM bw
  UNION ALL SELECT item_id * 6 + 3, 'none', [unnest(w[5:6])], FALSE, NULL FROM bw
  UNION ALL SELECT item_id * 6 + 4, 'all', [w[2]], FALSE, 'content' FROM bw
  UNION ALL SELECT item_id * 6 + 4, 'all', [w[5][1:4]], TRUE, 'content' FROM bw
  UNION ALL SELECT item_id * 6 + 5, 'any', [unnest(['src3', 'en', w[1]])], FALSE, 'tags' FROM bw)
, unit AS (SELECT query_id, role, toks, prefix, field, COUNT(*) AS repeats FROM raw GROUP BY ALL)
, def AS (SELECT DISTINCT toks, prefix, COALESCE(field, '') AS field FROM unit)
, occ AS (
  SELECT d.toks, d.prefix, d.field, pos.id, COUNT(*) AS tf FROM def d JOIN pos
    ON pos.toks[pos.p] = d.toks[1] AND pos.toks[pos.p:pos.p + len(d.toks) - 1] = d.toks AND (d.field = '' OR d.field = pos.f)
  WHERE NOT d.prefix GROUP BY ALL
  UNION ALL SELECT d.toks, d.prefix, d.field, pos.id, COUNT(*) FROM def d JOIN pos
    ON starts_with(pos.toks[pos.p], d.toks[1]) AND (d.field = '' OR d.field = pos.f) WHERE d.prefix GROUP BY ALL)
, nt AS (SELECT toks, prefix, field, COUNT(*) AS n_t FROM occ GROUP BY ALL)
, need3 AS (SELECT query_id, COUNT(*) FILTER (WHERE role = 'all') AS n_all, COUNT(*) FILTER (WHERE role = 'any') AS n_any
            FROM unit GROUP BY query_id)
, hit AS (SELECT u.query_id, u.role, u.repeats, o.id, o.tf, n.n_t, CASE WHEN len(u.toks) = 1 AND NOT u.prefix AND u.field IS NULL
            THEN u.toks[1] ELSE chr(1) || CAST(u.toks AS VARCHAR) || u.prefix END AS name FROM unit u
          JOIN occ o ON o.toks = u.toks AND o.prefix = u.prefix AND o.field = COALESCE(u.field, '')
          JOIN nt n ON n.toks = o.toks AND n.prefix = o.prefix AND n.field = o.field)
, sc3 AS (SELECT h.query_id, h.id, COUNT(*) FILTER (WHERE role = 'all') AS g_all, COUNT(*) FILTER (WHERE role = 'any') AS g_any,
            COUNT(*) FILTER (WHERE role = 'none') AS g_none,
            list_reduce([0.0::DOUBLE] || list(h.repeats * greatest(ln((st3.n_rows - h.n_t + 0.5) / (h.n_t + 0.5)), 1e-6)
                * (h.tf * 2.2) / (h.tf + 1.2 * (0.25 + 0.75 * l.dl / st3.avgdl)) ORDER BY h.name) FILTER (role <> 'none'), lambda a, b: a + b) AS score
          FROM hit h JOIN lens3 l ON l.id = h.id CROSS JOIN st3 GROUP BY h.query_id, h.id)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT s.query_id, s.id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, r.created_at DESC, s.id) AS rank
  FROM sc3 s JOIN need3 n ON n.query_id = s.query_id JOIN records r ON r.id = s.id
  WHERE g_all = n_all AND g_none = 0 AND (n_any = 0 OR g_any > 0) AND n_all + n_any > 0)"""


@register("structured_search", _with(_STRUCTURED_SQL))
def q_structured_search(spark, sf_dir):
    """Q5: required, alternative and excluded terms, phrases, prefixes and fields combined; every hit, ranked."""
    res = se.structured_search(_rec(spark, sf_dir), structured_queries(spark, sf_dir), limit=None, stem=False)
    return res.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@register("stems", f"""
SELECT term, stem FROM ({stem_sql(f"SELECT DISTINCT unnest({_fts_tokens_sql('text')}) AS term FROM documents")})""")
def q_stems(spark, sf_dir):
    """Q2: every distinct term and its stem (held against SQLite in the tests too)."""
    toks = fx.table(spark, sf_dir, "documents").select(F.explode(fts_tokens("text")).alias("term"))
    return se.stem_vocabulary(toks)


# ----------------------------------------------------------- owner scope ---

_OWNED_SQL = f"""WITH rec AS (
  SELECT conv_id AS owner, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS id, text AS content, turn,
         role <> 'user' AS sensitive FROM conversations)
, q AS (SELECT conv_id AS owner, turn AS query_id, text AS query FROM conversations WHERE role = 'user')"""


def owned_records(spark, sf_dir) -> DataFrame:
    """Conversation turns as records of their conversation (the owner)."""
    c = fx.table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(int(fx.VIEW_EPOCH.timestamp())) + F.col("turn"))
    return c.select(F.col("conv_id").alias("owner"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
                    F.col("text").alias("content"), F.lit("manual").alias("source"), F.lit("personal").alias("category"),
                    F.array().cast("array<string>").alias("tags"), (F.col("role") != "user").alias("sensitive"),
                    F.lit(0.9).alias("confidence"), at.alias("created_at"), at.alias("updated_at"), F.lit(None).cast("string").alias("source_raw"))


def owned_queries(spark, sf_dir) -> DataFrame:
    """Each user turn asks its own conversation."""
    c = fx.table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.col("conv_id").alias("owner"), F.col("turn").alias("query_id"), F.col("text").alias("query"))


@register("keyword_by_owner", _OWNED_SQL + f"""
, qw AS (SELECT owner, query_id, word, COUNT(*) AS repeats FROM (
    SELECT owner, query_id, unnest(regexp_split_to_array(lower(query), '[{PY_WHITESPACE}]+')) AS word FROM q) WHERE word <> '' GROUP BY ALL)
, hits AS (SELECT qw.owner, qw.query_id, r.id, r.turn, CAST(SUM(qw.repeats) AS BIGINT) AS score
           FROM qw JOIN rec r ON r.owner = qw.owner AND contains(lower(r.content || ' '), qw.word) GROUP BY ALL)
SELECT owner, query_id, id, score, CAST(row_number() OVER w AS BIGINT) AS rank FROM hits
WINDOW w AS (PARTITION BY owner, query_id ORDER BY score DESC, turn DESC, id) QUALIFY row_number() OVER w <= 3""")
def q_keyword_by_owner(spark, sf_dir):
    """Q7 in each owner's own rows."""
    res = kw.keyword_search(owned_records(spark, sf_dir), owned_queries(spark, sf_dir), limit=3, by=["owner"])
    return res.select("owner", "query_id", "id", "score", F.col("rank").cast("bigint"))


@register("search_by_owner", _OWNED_SQL + f"""
, tk AS (SELECT owner, id, unnest({_fts_tokens_sql('content')}) AS term FROM rec)
, post AS (SELECT owner, term, id, COUNT(*) AS tf FROM tk GROUP BY ALL)
, lens AS (SELECT r.owner, r.id, r.turn, len({_fts_tokens_sql('content')}) AS dl FROM rec r)
, st AS (SELECT owner, COUNT(*) AS n_rows, SUM(dl) / COUNT(*) AS avgdl FROM lens GROUP BY owner)
, tstat AS (SELECT owner, term, COUNT(*) AS n_t FROM post GROUP BY ALL)
, qt AS (SELECT owner, query_id, term, COUNT(*) AS repeats FROM (
         SELECT owner, query_id, unnest({_fts_tokens_sql('query')}) AS term FROM q) GROUP BY ALL)
, need AS (SELECT owner, query_id, COUNT(*) AS n FROM qt GROUP BY ALL)
, sc AS (SELECT qt.owner, qt.query_id, p.id, COUNT(*) AS n,
           SUM(qt.repeats * greatest(ln((st.n_rows - t.n_t + 0.5) / (t.n_t + 0.5)), 1e-6)
             * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / st.avgdl))) AS score
         FROM qt JOIN post p ON p.owner = qt.owner AND p.term = qt.term JOIN tstat t ON t.owner = qt.owner AND t.term = qt.term
         JOIN lens l ON l.owner = p.owner AND l.id = p.id JOIN st ON st.owner = qt.owner GROUP BY ALL)
SELECT owner, query_id, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT sc.owner, sc.query_id, sc.id, sc.score,
         row_number() OVER (PARTITION BY sc.owner, sc.query_id ORDER BY round(sc.score, 9) DESC, l.turn DESC, sc.id) AS rank
  FROM sc JOIN need n ON n.owner = sc.owner AND n.query_id = sc.query_id AND n.n = sc.n JOIN lens l ON l.owner = sc.owner AND l.id = sc.id) WHERE rank <= 5""")
def q_search_by_owner(spark, sf_dir):
    """Q4 in each owner's own rows and statistics; each user turn is a query."""
    res = se.search(owned_records(spark, sf_dir), owned_queries(spark, sf_dir), limit=5, stem=False, by=["owner"])
    return res.select("owner", "query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


def owner_rules(spark, sf_dir) -> DataFrame:
    """Rules documents of the conversations: every third hides nothing
    sensitive, every fourth hides a keyword, every fifth is unreadable, the
    others name a key of their own; one conversation in seven has none."""
    o = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner")).distinct().where("owner % 7 <> 0")
    doc = (F.when(F.col("owner") % 3 == 0, F.lit('{"exclude_sensitive": false}'))
           .when(F.col("owner") % 4 == 0, F.lit('{"exclude_keywords": ["TH"], "exclude_tags": ["x"]}'))
           .when(F.col("owner") % 5 == 0, F.lit("{broken")).otherwise(F.lit('{"exclude_sensitive": true, "theme": 1}')))
    return o.select("owner", doc.alias("value"))


_OWNER_RULES_SQL = """
, o AS (SELECT DISTINCT owner FROM rec WHERE owner % 7 <> 0)
, rules AS (SELECT owner, owner % 3 <> 0 AS exclude_sensitive,
              CASE WHEN owner % 3 <> 0 AND owner % 4 = 0 THEN 'x' ELSE '' END AS exclude_tags,
              CASE WHEN owner % 3 <> 0 AND owner % 4 = 0 THEN 'TH' ELSE '' END AS exclude_keywords FROM o)"""


@register("rules_table", _OWNED_SQL + _OWNER_RULES_SQL + "\nSELECT owner, exclude_sensitive, exclude_tags, exclude_keywords FROM rules")
def q_rules_table(spark, sf_dir):
    """rules of every owner, with defaults."""
    r = rl.rules_table(owner_rules(spark, sf_dir))
    return r.select("owner", "exclude_sensitive", F.array_join("exclude_tags", ",").alias("exclude_tags"),
                    F.array_join("exclude_keywords", ",").alias("exclude_keywords"))


@register("unknown_rule_keys", """
SELECT DISTINCT conv_id AS owner, 'theme' AS unknown_keys FROM conversations
WHERE conv_id % 7 <> 0 AND conv_id % 3 <> 0 AND conv_id % 4 <> 0 AND conv_id % 5 <> 0""")
def q_unknown_rule_keys(spark, sf_dir):
    """documents that name a key that is no rule."""
    return rl.unknown_rule_keys(owner_rules(spark, sf_dir)).select("owner", F.array_join("unknown_keys", ",").alias("unknown_keys"))


@register("exclude_by_owner", _OWNED_SQL + _OWNER_RULES_SQL + """
SELECT r.id FROM rec r LEFT JOIN rules u ON u.owner = r.owner
WHERE NOT (COALESCE(u.exclude_sensitive, TRUE) AND r.sensitive)
  AND NOT (COALESCE(u.exclude_keywords, '') <> '' AND contains(lower(r.content), lower(u.exclude_keywords)))""")
def q_exclude_by_owner(spark, sf_dir):
    """F12 with the rules of each row's owner."""
    return exclude(owned_records(spark, sf_dir), rl.rules_table(owner_rules(spark, sf_dir)), by=["owner"]).select("id")


@register("rule_settings", _OWNED_SQL + _OWNER_RULES_SQL + """
, last AS (SELECT conv_id AS owner, max(turn) AS t, max(turn) FILTER (WHERE turn % 2 = 0) AS te,
             max(turn) FILTER (WHERE turn % 2 = 1) AS td FROM conversations GROUP BY conv_id)
SELECT r.owner, COALESCE(l.te % 4 = 0, r.exclude_sensitive) AS exclude_sensitive,
       CASE WHEN l.td IS NULL THEN r.exclude_tags ELSE 't' || CAST(l.td AS VARCHAR) || ',b' END AS exclude_tags
FROM rules r JOIN last l ON l.owner = r.owner""")
def q_rule_settings(spark, sf_dir):
    """each turn is a setting of its conversation's rules; the last of a key wins."""
    c = fx.table(spark, sf_dir, "conversations")
    even = F.col("turn") % 2 == 0
    value = F.when(even & (F.col("turn") % 4 == 0), " Yes").when(even, "no") \
        .otherwise(F.concat(F.lit(" t"), F.col("turn").cast("string"), F.lit(", ,b ")))
    settings = c.select(F.col("conv_id").alias("owner"), F.col("turn").alias("seq"),
                        F.when(even, "exclude_sensitive").otherwise("exclude_tags").alias("key"), F.trim(value).alias("value"))
    new = rl.apply_rule_settings(rl.rules_table(owner_rules(spark, sf_dir)), rl.parse_rule_settings(settings), by=["owner"])
    return new.select("owner", "exclude_sensitive", F.array_join("exclude_tags", ",").alias("exclude_tags"))


@register("exclude_tags", _with("SELECT id FROM records WHERE len(list_intersect(tags, ['src3', 'de'])) = 0"))
def q_exclude_tags(spark, sf_dir):
    """F16."""
    return rl.exclude_tags(_rec(spark, sf_dir), ["src3", "de"]).select("id")


# ----------------------------------------- exact duplicates, keys, changes ---

def _stored_and_incoming(spark, sf_dir):
    table = ig.manual_records(fx.conversation_records(spark, sf_dir).withColumn("category", F.lit("personal")), AS_OF)
    pos = F.col("id").cast("bigint")
    inc = _rec(spark, sf_dir).withColumn("file", F.lit("documents")).withColumn("pos", pos)
    # A third of the batch again as copies of one text, behind all others.
    hot = inc.where(pos % 3 == 0).withColumn("content", F.lit("Hot text.")).withColumn("file", F.lit("hot")) \
        .withColumn("id", F.concat(F.lit("h"), F.col("id")))
    talk = fx.conversation_records(spark, sf_dir).select(F.col("content"), F.concat_ws("/", F.lit("c"), F.col("owner").cast("string"),
                                                         F.col("pos").cast("string")).alias("id"), F.lit("talk").alias("file"),
                                                         (F.col("owner") * 1000 + F.col("pos")).alias("pos"))
    cols = ["id", "content", "file", "pos"]
    return table, inc.select(*cols).unionByName(hot.select(*cols)).unionByName(talk.select(*cols))


_INCOMING_SQL = """
, inc AS (SELECT id, content, 'documents' AS file, CAST(id AS BIGINT) AS pos FROM records
          UNION ALL SELECT 'h' || id, 'Hot text.', 'hot', CAST(id AS BIGINT) FROM records WHERE CAST(id AS BIGINT) % 3 = 0
          UNION ALL SELECT 'c/' || conv_id || '/' || turn, text, 'talk', conv_id * 1000 + turn FROM conversations)"""


@register("new_rows", _with(_INCOMING_SQL + "\nSELECT id FROM inc WHERE content NOT IN (SELECT text FROM conversations)"))
def q_new_rows(spark, sf_dir):
    """Incoming rows whose text is not stored; a third of them hold one text."""
    table, inc = _stored_and_incoming(spark, sf_dir)
    return dd.new_rows(table, inc).select("id")


@register("dedup_batch", _with(_INCOMING_SQL + """
SELECT id FROM inc QUALIFY row_number() OVER (PARTITION BY content ORDER BY file, pos) = 1"""))
def q_dedup_batch(spark, sf_dir):
    """The first row of each text."""
    return dd.dedup_batch(_stored_and_incoming(spark, sf_dir)[1]).select("id")


@register("check_keys", _with("""
SELECT id, CAST(2 AS BIGINT) AS n FROM records WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"""))
def q_check_keys(spark, sf_dir):
    """D3: ids that would be held twice after the labelled rows are added again."""
    rec = _rec(spark, sf_dir)
    again = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id")).join(rec, "id", "left_semi")
    return dd.check_keys(rec, again)


@register("apply_edits", _with("""
, ch AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality, toxic FROM labels)
SELECT r.id, sha256(CASE WHEN ch.toxic = 1 THEN 'edited ' || r.id ELSE r.content END) AS content_key,
       CASE WHEN ch.quality = 1 THEN 'project' ELSE r.category END AS category,
       CASE WHEN ch.quality = 0 THEN 'a||b' ELSE array_to_string(r.tags, '|') END AS tags
FROM records r LEFT JOIN ch ON r.id = ch.id AND NOT (ch.quality = 0 AND ch.toxic = 1)"""))
def q_apply_edits(spark, sf_dir):
    """M2: edits from the labels (empty content keeps the old one, blanks of tags stay); some name a category that does not exist."""
    lab = fx.table(spark, sf_dir, "labels")
    sid = F.col("doc_id").cast("string")
    ch = lab.select(sid.alias("id"), F.when(F.col("toxic") == 1, F.concat(F.lit("edited "), sid)).otherwise("").alias("content"),
                    F.when(F.col("quality") == 1, "project").when(F.col("toxic") == 1, "bogus").alias("category"),
                    F.when(F.col("quality") == 0, " a,, b ").alias("tags"))
    new, _, _ = chg.apply_edits(_rec(spark, sf_dir), ch, AS_OF)
    return new.select("id", F.sha2("content", 256).alias("content_key"), "category", F.array_join("tags", "|").alias("tags"))


@register("rejected_edits", """
SELECT CAST(doc_id AS VARCHAR) AS id, 'bad_category' AS problems FROM labels WHERE quality = 0 AND toxic = 1""")
def q_rejected_edits(spark, sf_dir):
    """P9 before M2: the changes that are not applied."""
    lab = fx.table(spark, sf_dir, "labels")
    ch = lab.select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("content"),
                    F.when(F.col("quality") == 1, "project").when(F.col("toxic") == 1, "bogus").alias("category"))
    return chg.split_changes(ch, content_required=False)[1].select("id", F.array_join("problems", ",").alias("problems"))


@register("clear_source", _with("SELECT id FROM records WHERE source <> 'claude'"))
def q_clear_source(spark, sf_dir):
    """M5."""
    return chg.clear_source(_rec(spark, sf_dir), "claude")[0].select("id")


@register("clear_all", _with("SELECT 'deleted' AS metric, COUNT(*) AS value FROM records"))
def q_clear_all(spark, sf_dir):
    """M6: the number of rows removed, and those left (none)."""
    left, report = chg.clear_all(_rec(spark, sf_dir))
    return report.unionByName(left.select(F.lit("left").alias("metric"), F.lit(1).cast("bigint").alias("value")))


# ------------------------------------------------ validation, legacy, packs ---

@register("validate", _with("""
, bad AS (SELECT id, concat_ws(',', CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'bad_category' END,
                               CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'bad_confidence' END) AS problems FROM records)
SELECT id, problems FROM bad"""))
def q_validate(spark, sf_dir):
    """Every fourth record has a category, every sixth a confidence, that is not allowed."""
    n = F.col("id").cast("bigint")
    rec = _rec(spark, sf_dir).withColumn("category", F.when(n % 4 == 0, "odd").otherwise(F.col("category"))) \
        .withColumn("confidence", F.when(n % 6 == 0, 1.5).otherwise(F.col("confidence")))
    good, bad = validate(rec)
    return good.select("id", F.lit("").alias("problems")).unionByName(bad.select("id", F.array_join("problems", ",").alias("problems")))


@register("decode_legacy", _with("""
SELECT id, array_to_string(tags, ',') AS tags, sensitive, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM records"""))
def q_decode_legacy(spark, sf_dir):
    """Rows as stored text back to typed rows, the flag column missing and added again."""
    rec = _rec(spark, sf_dir)
    iso = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    legacy = rec.select("id", "content", "source", "category", F.to_json("tags").alias("tags"), F.col("sensitive").cast("int").alias("sensitive"),
                        "confidence", iso.alias("created_at"), iso.alias("updated_at"), "source_raw")
    return upgrade_schema(decode_legacy(legacy)).select("id", F.array_join("tags", ",").alias("tags"), "sensitive", ts_str("created_at").alias("created_at"))


@register("upgrade_schema", _with("SELECT id, FALSE AS sensitive, CAST(0.8 AS DOUBLE) AS confidence, 0 AS n_tags FROM records"))
def q_upgrade_schema(spark, sf_dir):
    """M8: columns that an older table lacks come with their defaults."""
    old = _rec(spark, sf_dir).drop("sensitive", "confidence", "tags", "source_raw")
    return upgrade_schema(old).select("id", "sensitive", "confidence", F.size("tags").alias("n_tags"))


@register("define_packs", """
WITH d AS (SELECT source AS name, doc_id AS seq, lang FROM documents), new AS (SELECT name, arg_max(lang, seq) AS l FROM d GROUP BY name)
SELECT name, 'personal,' || l AS categories FROM new WHERE name NOT IN ('src1', 'src2')
UNION ALL SELECT 'kept', 'project'""")
def q_define_packs(spark, sf_dir):
    """K1, K4: a definition a document, named after its source; the last of a name stands, two packs are dropped again."""
    d = fx.table(spark, sf_dir, "documents")
    defs = d.select(F.col("source").alias("name"), F.concat(F.lit("personal, "), F.col("lang")).alias("categories"), F.lit("").alias("tags"),
                    F.lit("").alias("exclude_tags"), F.lit("").alias("description"), F.col("doc_id").alias("seq"))
    old = pk.parse_pack_defs(spark.createDataFrame([("kept", "project", "", "", ""), ("src3", "project", "", "", "")],
                                                   "name string, categories string, tags string, exclude_tags string, description string"))
    packs = pk.drop_packs(pk.define_packs(old, defs), spark.createDataFrame([("src1",), ("src2",)], "name string"))
    return packs.select("name", F.array_join("categories", ",").alias("categories"))


# ------------------------------------------------------ exports of all kinds ---

def chatgpt_exports(spark, sf_dir) -> DataFrame:
    """An export file a conversation: an array of all its turns, user turns as
    memories, system turns blank, assistant turns of a wrong type."""
    c = fx.table(spark, sf_dir, "conversations")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60), "yyyyMMdd'T'HHmmss")
    e = (F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("memory"), at.alias("created_at"))))
         .when(F.col("role") == "system", F.lit('{"memory": "  "}')).otherwise(F.to_json(F.array("text"))))
    return (c.select("conv_id", "turn", e.alias("e")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "e"))).alias("t"))
            .select(F.col("conv_id").cast("string").alias("file"),
                    F.concat(F.lit("["), F.array_join(F.transform("t", lambda x: x["e"]), ","), F.lit("]")).alias("value")))


def gemini_exports(spark, sf_dir) -> DataFrame:
    """A wrapper object a conversation: odd ones hold ``items`` behind an empty
    ``memories``, every fifth file is broken, every seventh holds no array."""
    c = fx.table(spark, sf_dir, "conversations")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60), "yyyy-MM-dd HH:mm:ss")
    e = (F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("title"), at.alias("timestamp"))))
         .when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("").alias("memory"), F.col("text").alias("text"), F.lit("12:30").alias("created_at"))))
         .otherwise(F.to_json(F.struct(F.lit(7).alias("content")))))
    t = c.select("conv_id", "turn", e.alias("e")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "e"))).alias("t"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("t", lambda x: x["e"]), ","), F.lit("]"))
    n = F.col("conv_id")
    doc = (F.when(n % 5 == 0, F.lit("{broken")).when(n % 7 == 0, F.lit('"text"'))
           .when(n % 2 == 1, F.concat(F.lit('{"memories": [], "items": '), listed, F.lit("}"))).otherwise(F.concat(F.lit('{"memories": '), listed, F.lit("}"))))
    return t.select(n.cast("string").alias("file"), doc.alias("value"))


_GPT_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, {_CONV_STRIP} AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)"""


@register("ingest_chatgpt", _GPT_SQL + f"""
SELECT sha256('chatgpt|' || conv_id || '|' || pos || '|' || c) AS id, CAST(pos AS BIGINT) AS pos,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL '1' MINUTE, '%Y-%m-%d %H:%M:%S') AS created_at,
       {_classify_sql(PLATFORMS['chatgpt']).replace('(content)', '(c)')} AS category
FROM c WHERE role = 'user' AND c <> ''""")
def q_ingest_chatgpt(spark, sf_dir):
    """Records of exports with several elements, compact times."""
    recs, _ = ex.parse_documents(chatgpt_exports(spark, sf_dir), "chatgpt", AS_OF)
    return recs.select("id", "pos", ts_str("created_at").alias("created_at"), "category")


def large_exports(spark, sf_dir) -> DataFrame:
    """Sixteen large exports, written as text: one array of the turns of many
    conversations each, behind a first element that is null."""
    c = fx.table(spark, sf_dir, "conversations")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60), "yyyyMMdd'T'HHmmss")
    e = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("memory"), at.alias("created_at")))).otherwise(F.to_json(F.array("text")))
    lines = c.select((F.col("conv_id") % 16).cast("int").alias("export"), F.lit(1).alias("at"), "conv_id", "turn", F.concat(F.lit(","), e).alias("line"))
    ends = spark.range(16).select(F.col("id").cast("int").alias("export"), F.inline(F.array(
        F.struct(F.lit(0).alias("at"), F.lit("[null").alias("line")), F.struct(F.lit(2).alias("at"), F.lit("]").alias("line")))))
    lines = lines.unionByName(ends, allowMissingColumns=True)
    path = f"{checkpoint_dir(spark).rstrip('/')}/memlake-exports-{uuid.uuid4().hex}"
    (lines.repartition("export").sortWithinPartitions("export", "at", "conv_id", "turn").select("export", "line")
     .write.partitionBy("export").text(path))
    written = spark.read.text(path)
    written._materialized_at = path
    return written


@register("ingest_large_arrays", f"""
WITH t AS (SELECT conv_id % 16 AS export, turn, role, {_CONV_STRIP} AS c,
                  row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn) AS pos FROM conversations)
SELECT CAST(export AS BIGINT) AS export, CAST(pos AS BIGINT) AS pos, sha256(c) AS content_sha256,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL '1' MINUTE, '%Y-%m-%d %H:%M:%S') AS created_at,
       {_classify_sql(PLATFORMS['chatgpt']).replace('(content)', '(c)')} AS category
FROM t WHERE role = 'user' AND c <> ''""")
def q_ingest_large_arrays(spark, sf_dir):
    """Records of arrays of any size, each read by as many tasks as it has splits."""
    exports = large_exports(spark, sf_dir)
    elements = array_elements(spark, exports._materialized_at)
    recs, _ = parse_array_elements(elements, "chatgpt", AS_OF)
    export = F.regexp_extract("file", "/export=([0-9]+)/", 1).cast("bigint").alias("export")
    out = materialize(recs.select(export, "pos", F.sha2("content", 256).alias("content_sha256"),
                                  ts_str("created_at").alias("created_at"), "category"), "large-arrays")
    drop_materialized(elements, exports)
    return out


@register("rejects_chatgpt", _GPT_SQL + """
SELECT CAST(conv_id AS VARCHAR) AS file, CAST(pos AS BIGINT) AS pos,
       CASE WHEN role = 'assistant' THEN 'wrong_element_type' ELSE 'blank' END AS reason
FROM c WHERE role = 'assistant' OR role = 'system' OR c = ''""")
def q_rejects_chatgpt(spark, sf_dir):
    """Every element that is no record, with its place and reason."""
    _, rej = ex.parse_documents(chatgpt_exports(spark, sf_dir), "chatgpt", AS_OF)
    return rej.select("file", "pos", "reason")


@register("ingest_gemini", _GPT_SQL + """
SELECT sha256('gemini|' || conv_id || '|' || pos || '|' || c) AS id,
       CASE WHEN role = 'user' THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL '1' MINUTE, '%Y-%m-%d %H:%M:%S')
            ELSE '2024-07-20 00:00:00' END AS created_at
FROM c WHERE conv_id % 5 <> 0 AND conv_id % 7 <> 0 AND role IN ('user', 'assistant') AND c <> ''""")
def q_ingest_gemini(spark, sf_dir):
    """Wrapper objects; a time alone is no time."""
    recs, _ = ex.parse_documents(gemini_exports(spark, sf_dir), "gemini", AS_OF)
    return recs.select("id", ts_str("created_at").alias("created_at"))


@register("reject_counts", _GPT_SQL + """
, r AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'unparseable' ELSE 'not_an_array' END AS reason FROM c
        WHERE conv_id % 5 = 0 OR conv_id % 7 = 0)
SELECT 'gemini' AS platform, reason, COUNT(*) AS n FROM r GROUP BY reason
UNION ALL SELECT 'gemini', CASE WHEN role IN ('user', 'assistant') THEN 'blank' ELSE 'bad_text_type' END AS reason, COUNT(*) FROM c
WHERE conv_id % 5 <> 0 AND conv_id % 7 <> 0 AND (role NOT IN ('user', 'assistant') OR c = '') GROUP BY ALL""")
def q_reject_counts(spark, sf_dir):
    """Rejects by reason, of files and of elements."""
    _, rej = ex.parse_documents(gemini_exports(spark, sf_dir), "gemini", AS_OF)
    return ex.reject_counts(rej)


@register("ingest_json_lines", f"""
WITH c AS (SELECT conv_id, turn, {_CONV_STRIP} AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS file, CAST(pos AS BIGINT) AS pos, c AS content FROM c WHERE c <> ''""")
def q_ingest_json_lines(spark, sf_dir):
    """S2 from JSON Lines: an element a line, a file a conversation."""
    c = fx.table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.col("text").alias("memory")))
    docs = (c.select("conv_id", "turn", line.alias("e")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "e"))).alias("t"))
            .select(F.col("conv_id").cast("string").alias("file"), F.array_join(F.transform("t", lambda x: x["e"]), "\n").alias("value")))
    recs, _ = ex.parse_documents(docs, "claude", AS_OF, lines=True)
    return recs.select("file", "pos", "content")


# --------------------------------------------------------- written and reread ---

@register("export_json", _with("""
SELECT id, source, category, array_to_string(tags, ',') AS tags, sensitive, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM records WHERE source = 'claude'"""))
def q_export_json(spark, sf_dir):
    """One source written as JSON Lines and read again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/memlake-export-{uuid.uuid4().hex}"
    tb.export_json(_rec(spark, sf_dir), path, source="claude")
    back = spark.read.schema("id string, source string, category string, tags array<string>, sensitive boolean, created_at timestamp").json(path)
    return back.select("id", "source", "category", F.array_join("tags", ",").alias("tags"), "sensitive", ts_str("created_at").alias("created_at"))


@register("snapshot", _with("SELECT id, source, category, sensitive, confidence FROM records"))
def q_snapshot(spark, sf_dir):
    """A snapshot written, found as the latest and read with the fixed schema."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/memlake-snapshots-{uuid.uuid4().hex}"
    tb.write_snapshot(_rec(spark, sf_dir).limit(0), base, 1)
    tb.write_snapshot(_rec(spark, sf_dir), base, 2)
    path = tb.snapshot_path(base, tb.latest_version(spark, base))
    return tb.read_table(spark, path).select("id", "source", "category", "sensitive", "confidence")


@register("render_list", _with(f"""
SELECT id, lpad(CAST(n AS VARCHAR), 3, ' ') || '. [' || rpad(source, CAST(greatest(8, len(source)) AS INTEGER), ' ') || '] [' || rpad(category, CAST(greatest(12, len(category)) AS INTEGER), ' ')
  || '] ' || content[1:60] || CASE WHEN sensitive THEN ' [SENSITIVE]' ELSE '' END || chr(10) || '     Tags: ' || array_to_string(tags, ', ')
  || chr(10) || '     ID: ' || id || '  |  Age: ' || CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000) AS BIGINT) || 'd' AS line
FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM records) WHERE n <= 20"""))
def q_render_list(spark, sf_dir):
    """List form of the newest page."""
    rows = fl.with_position(fl.page(_rec(spark, sf_dir), limit=20), start=1)
    return rows.select("id", render_short(F.col("position"), verbose=True, as_of=AS_OF).alias("line"))


@register("page_by_owner", _OWNED_SQL + """
SELECT id FROM rec QUALIFY row_number() OVER (PARTITION BY owner ORDER BY turn DESC, id) BETWEEN 2 AND 3""")
def q_page_by_owner(spark, sf_dir):
    """L1 for every owner."""
    return fl.page(owned_records(spark, sf_dir), limit=2, offset=1, by=["owner"]).select("id")


@register("prompts_by_owner", _OWNED_SQL + f"""
, qw AS (SELECT owner, query_id, word, COUNT(*) AS repeats FROM (
    SELECT owner, query_id, unnest(regexp_split_to_array(lower(query), '[{PY_WHITESPACE}]+')) AS word FROM q) WHERE word <> '' GROUP BY ALL)
, hits AS (SELECT qw.owner, qw.query_id, r.id, r.turn, r.content, r.sensitive, SUM(qw.repeats) AS score
           FROM qw JOIN rec r ON r.owner = qw.owner AND contains(lower(r.content || ' '), qw.word) GROUP BY ALL)
, top AS (SELECT *, row_number() OVER (PARTITION BY owner, query_id ORDER BY score DESC, turn DESC, id) AS rank FROM hits
          QUALIFY row_number() OVER (PARTITION BY owner, query_id ORDER BY score DESC, turn DESC, id) <= 8)
, agg AS (SELECT owner, query_id, string_agg('[PERSONAL] ' || content, chr(10) ORDER BY rank) AS block FROM top WHERE NOT sensitive GROUP BY ALL)
SELECT q.owner, q.query_id, CASE WHEN a.block IS NULL THEN q.query ELSE '## Personal Context' || chr(10) || a.block || chr(10) || chr(10)
  || '---' || chr(10) || chr(10) || q.query END AS prompt FROM q LEFT JOIN agg a ON a.owner = q.owner AND a.query_id = q.query_id""")
def q_prompts_by_owner(spark, sf_dir):
    """K5 in each owner's own rows."""
    return pk.prompts(owned_records(spark, sf_dir), owned_queries(spark, sf_dir), Rules(), limit=8, by=["owner"]).select("owner", "query_id", "prompt")


@register("render_hits", _with(_KW_SQL + """
SELECT r.query_id, CAST(r.rank AS VARCHAR) || '. [' || rpad(source, CAST(greatest(8, len(source)) AS INTEGER), ' ') || '] ['
  || rpad(category, CAST(greatest(12, len(category)) AS INTEGER), ' ') || '] ' || content[1:65] || CASE WHEN sensitive THEN ' [SENSITIVE]' ELSE '' END
  || chr(10) || '   Tags: ' || array_to_string(tags, ', ') AS line
FROM ranked r JOIN records x ON x.id = r.id WHERE r.rank <= 5"""))
def q_render_hits(spark, sf_dir):
    """P8 search form: the keyword hits of every benchmark text."""
    rec = _rec(spark, sf_dir)
    hits = kw.keyword_search(rec, fx.queries_table(spark, sf_dir), limit=5).select("query_id", "id", "rank")
    return hits.join(rec, "id").select("query_id", render_hit(F.col("rank")).alias("line"))


@register("rules_listing", _OWNED_SQL + _OWNER_RULES_SQL + """
SELECT owner, 'exclude_sensitive' AS rule, CASE WHEN exclude_sensitive THEN 'true' ELSE 'false' END AS value FROM rules
UNION ALL SELECT owner, 'exclude_tags', CASE WHEN exclude_tags = '' THEN '[]' ELSE '["' || exclude_tags || '"]' END FROM rules
UNION ALL SELECT owner, 'exclude_categories', '[]' FROM rules
UNION ALL SELECT owner, 'exclude_keywords', CASE WHEN exclude_keywords = '' THEN '[]' ELSE '["' || exclude_keywords || '"]' END FROM rules""")
def q_rules_listing(spark, sf_dir):
    """every rule of every owner, set or not."""
    return rl.active_rules(rl.rules_table(owner_rules(spark, sf_dir))).select("owner", "rule", "value")


@register("page_after", _with("""
, k AS (SELECT created_at, id FROM records ORDER BY created_at DESC, id LIMIT 1 OFFSET 9)
SELECT r.id, strftime(r.created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM records r, k
WHERE r.created_at < k.created_at OR (r.created_at = k.created_at AND r.id > k.id) ORDER BY r.created_at DESC, r.id LIMIT 20"""))
def q_page_after(spark, sf_dir):
    """L1 by key: the page behind the tenth row, equal to the page from place ten."""
    rec = _rec(spark, sf_dir)
    last = fl.page(rec, limit=1, offset=9).first()
    return fl.page_after(rec, last["created_at"], last["id"], 20).select("id", ts_str("created_at").alias("created_at"))


def change_log(spark, sf_dir) -> DataFrame:
    """Changes of every kind: conversation turns rewrite rows, labels flag, edit
    and delete rows (one label in four names a category that does not exist), one source goes."""
    none = F.lit(None).cast("string")
    no_tags, no_flag = F.lit(None).cast("array<string>"), F.lit(None).cast("boolean")

    def entry(seq, op, id, content=none, category=none, tags=no_tags, sensitive=no_flag, source=none, tag_text=none):
        return F.struct(seq.cast("bigint").alias("seq"), F.lit(op).alias("op"), id.alias("id"), content.alias("content"), category.alias("category"),
                        tags.alias("tags"), sensitive.alias("sensitive"), source.alias("source"), tag_text.alias("tag_text"))
    conv, lab = fx.table(spark, sf_dir, "conversations"), fx.table(spark, sf_dir, "labels")
    one, two = (F.col("conv_id") * 13).cast("string"), F.col("doc_id").cast("string")
    at = F.col("doc_id") * 7
    turns = conv.select(entry(F.col("turn") * 100, "update", one, F.col("text"), F.lit("project"), F.array(F.col("role"))).alias("e"))
    marks = lab.select(F.inline(F.array(
        entry(at, "sensitive", two, sensitive=F.col("quality") == 0),
        entry(at + 1, "edit", two, F.lit(""), F.when(F.col("doc_id") % 4 == 0, "bogus").otherwise("personal"), tag_text=F.lit("a, b")),
        entry(at + 2, "delete", F.when(F.col("toxic") == 1, two).otherwise("nobody")))))
    clear = spark.range(1).select(entry(F.lit(5), "clear_source", none, source=F.lit("gemini")).alias("e"))
    return turns.select("e.*").unionByName(marks).unionByName(clear.select("e.*"))


@register("apply_log", _with("""
, e AS (SELECT CAST(conv_id * 13 AS VARCHAR) AS id, turn * 100 AS seq, text AS content, 'project' AS category, role AS tags FROM conversations
        UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id * 7 + 1, NULL, 'personal', 'a|b' FROM labels WHERE doc_id % 4 <> 0)
, f AS (SELECT id, arg_max(content, seq) FILTER (content IS NOT NULL) AS content, arg_max(category, seq) AS category, arg_max(tags, seq) AS tags
        FROM e GROUP BY id)
, l AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality = 0 AS flag, toxic = 1 AS gone FROM labels)
SELECT r.id, sha256(COALESCE(f.content, r.content)) AS content_key, COALESCE(f.category, r.category) AS category,
       COALESCE(f.tags, array_to_string(r.tags, '|')) AS tags, COALESCE(l.flag, r.sensitive) AS sensitive,
       strftime(CASE WHEN f.id IS NULL AND l.id IS NULL THEN r.updated_at ELSE """ + CHANGE_AS_OF_SQL + """ END, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM records r LEFT JOIN f ON f.id = r.id LEFT JOIN l ON l.id = r.id WHERE r.source <> 'gemini' AND NOT COALESCE(l.gone, FALSE)"""))
def q_apply_log(spark, sf_dir):
    """M1-M5 mixed in one ordered log."""
    new, _ = chg.apply_log(_rec(spark, sf_dir), change_log(spark, sf_dir), AS_OF)
    return new.select("id", F.sha2("content", 256).alias("content_key"), "category", F.array_join("tags", "|").alias("tags"), "sensitive",
                      ts_str("updated_at").alias("updated_at"))

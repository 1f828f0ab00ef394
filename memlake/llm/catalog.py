"""Registered queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, language_id, merkle, pii, toxicity
from .common import table
from .decontamination import contamination
from .minhash_dedup import near_duplicates
from .packing import pack
from .quality import judge
from .secrets import secret_scan
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup


#: Key of the registered query and stage; production runs pass their own secret.
SURROGATE_KEY = "registered-query-key"


def _held_out(folds: int, fold: int):
    """A row with a null id is in no fold: it is scored, and may be learned."""
    return F.coalesce(toxicity.in_fold(F.col("doc_id"), folds, fold), F.lit(False))


def toxicity_machine(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Machine:
    """Learned from the labelled rows of ``docs`` outside the held-out fold."""
    labels = (table(spark, sf_dir, "labels").where(~_held_out(3, 1))
              .select("doc_id", F.col("toxic").alias("label")))
    return toxicity.fit(docs.select("doc_id", "text"), labels)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("found")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity_machine(spark, docs, sf_dir))
    return scores.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"), ~_held_out(4, 2))
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept_bytes")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"))
    coded = coded.withColumn("text", bpe.decoded(F.col("ids")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.lower_case_tampering(docs)).drop("path")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_toxicity, op3_language_id, op4_substring_dedup, op5_decontamination, op6_minhash_dedup,
    op7_quality_rules, op8_packing, op9_pii_surrogates, op10_suffix_dedup, op11_bpe, op12_merkle_manifest,
    op13_collocations)}

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

def _merkle_sql(levels: int = 8) -> str:
    """Each level as one query over the one below, ``8 ** levels`` rows of a language at most."""
    def value(x):
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR) END"
    head = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    crc = ("xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), "
           f"lambda u, x: list_reduce([xor(u, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: {step})), 4294967295)")
    parts = [f"""d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS sc, sha256({head} || {value('text')}) AS h,
  CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {value(f"translate(text, {_FOLD})")}) END AS t FROM documents)"""]

    def tree(x, nodes, rows):
        parts.append(f"{x}0 AS MATERIALIZED ({nodes})")
        parts.append(f"{x}r0 AS MATERIALIZED ({rows})")
        for k in range(levels):
            parts.append(f"""{x}{k + 1} AS MATERIALIZED (SELECT sc, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {x}{k} GROUP BY sc, pos // 8)""")
            parts.append(f"""{x}s{k} AS MATERIALIZED (SELECT a.sc, a.pos, any_value(a.n) AS n, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS bef,
  coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS beh FROM {x}{k} a JOIN {x}{k} b ON a.sc = b.sc AND a.pos // 8 = b.pos // 8 GROUP BY a.sc, a.pos)""")
            parts.append(f"""{x}r{k + 1} AS MATERIALIZED (SELECT r, q.sc, q.pos // 8 AS pos, q.proof || bef || beh AS proof,
  CASE WHEN n > 1 THEN sha256(bef || q.fold || beh) ELSE q.fold END AS fold FROM {x}r{k} q JOIN {x}s{k} s ON s.sc = q.sc AND s.pos = q.pos)""")
    place = "row_number() OVER (PARTITION BY sc ORDER BY doc_id NULLS FIRST, h, r) - 1"
    tree("a", f"SELECT sc, {place} AS pos, count(*) OVER (PARTITION BY sc) AS n, h FROM d",
         f"SELECT r, sc, {place} AS pos, '' AS proof, coalesce(t, h) AS fold FROM d")
    order = "row_number() OVER (ORDER BY sc) - 1"
    tree("b", f"SELECT '' AS sc, {order} AS pos, count(*) OVER () AS n, h FROM a{levels}",
         f"SELECT r, '' AS sc, o.pos, proof, fold FROM ar{levels} q JOIN (SELECT sc, {order} AS pos FROM a{levels}) o ON o.sc = q.sc")
    return "WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.h AS leaf, s.h AS subroot, z.h AS root, sha256(q.proof) AS proof_sha256, q.fold AS folded_root, q.fold = z.h AS verified
FROM d JOIN br{levels} q ON q.r = d.r JOIN a{levels} s ON s.sc = d.sc JOIN b{levels} z ON true"""


#: What SQL cannot express, or not at table size, is tested against brute force in tests/llm.
ORACLE_SQL = {
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)
, win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50))
, early AS (SELECT h, min(doc_id) AS d0 FROM win GROUP BY h)
, gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS q FROM win JOIN early USING (h) WHERE doc_id > d0)
, kept AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.q) AS x, count(*) AS n
           FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM d) t
           ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.q = t.q GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.x, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op5_decontamination": rf"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '{_ALNUM}') AS w FROM benchmark)
, win AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS x FROM (
    SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM iw WHERE len(w) > 0))
, dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '{_ALNUM}') AS w FROM documents)
, spot AS (SELECT doc_id, n, w[p:p + n - 1] AS x, p FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n))
, occ AS (SELECT s.doc_id, s.p, s.n, win.item_id FROM spot s JOIN win ON win.n = s.n AND win.x = s.x)
, hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM occ) GROUP BY doc_id)
, items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
            FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_FOLD}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
, w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p)
, g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k))
, f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY lang, k, phrase)
, n AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang)
, cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND c >= 30)
, cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
          FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM cand))
, scored AS (SELECT cut.lang, cut.phrase, cut.a, j, fl.c AS l, fr.c AS r, (CAST(2000000 AS HUGEINT) * cut.a) // (fl.c + fr.c) AS score
             FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.phrase = x JOIN f fr ON fr.lang = cut.lang AND fr.phrase = y)
, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
, sub AS (SELECT DISTINCT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a AS longer FROM (
    SELECT lang, w, a, s, unnest(generate_series(1, k - s + 1)) AS i FROM cand, (VALUES (2), (3)) v(s) WHERE s < k))
, kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM sub WHERE sub.lang = b.lang AND sub.phrase = b.phrase AND CAST(100 AS HUGEINT) * sub.longer >= CAST(80 AS HUGEINT) * b.a))
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000""",
}

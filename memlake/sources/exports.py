"""Chat-export readers.

An export is one JSON document per file: a top-level array of records, or (for
platforms with wrapper keys) an object holding the array.  Files are read
whole (``wholetext``) -- a directory of exports is one row per file, spread
over the cluster -- parsed to ``VARIANT`` and exploded to one row per
element.  Every element either becomes a record or a reject row with a
reason; an unparseable file is one reject row, never a failed job.  JSON Lines
(one element per line) is accepted as a second input form for very large
exports, which would otherwise be a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.classify import classify_frame, extract_tags
from memlake.functions.text import strip
from memlake.functions.timefn import parse_ts, ts_lit
from memlake.schema import RECORD_COLUMNS
from memlake.sources.platforms import PlatformSpec, get_platform

REJECT_COLUMNS = ["file", "pos", "platform", "reason", "raw"]


def read_export_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)``: one row per export file (whole text).

    A missing path raises (the reference's file-not-found error)."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("file"), "value")


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_falsy(v: Column) -> Column:
    """Missing / null / '' / 0 / false / empty array or object."""
    t = _type(v)
    s = F.try_variant_get(v, "$", "string")
    return (v.isNull() | (t == "VOID") | ((t == "STRING") & (s == "")) |
            (t.isin("BOOLEAN") & (s == "false")) |
            (t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$") &
             (F.try_variant_get(v, "$", "double") == 0)) |
            (t.startswith("ARRAY") & (F.coalesce(F.array_size(F.try_variant_get(v, "$", "array<variant>")),
                                                 F.lit(0)) == 0)) |
            (t == "OBJECT<>"))


def _first_truthy(e: Column, keys) -> tuple[Column, Column]:
    """(value, bad_type) for the first key whose value is truthy; bad_type is
    true when that value is not a string."""
    val, bad = F.lit(None).cast("string"), F.lit(False)
    for k in reversed(keys):
        v = F.try_variant_get(e, f"$.{k}", "variant")
        t = _type(v)
        truthy = ~_is_falsy(v)
        val = F.when(truthy & (t == "STRING"), F.try_variant_get(v, "$", "string")).when(truthy, None) \
            .otherwise(val)
        bad = F.when(truthy, t != "STRING").otherwise(bad)
    return val, bad


def _elements(files: DataFrame, spec: PlatformSpec) -> DataFrame:
    """``(file, pos, e, file_error)`` -- pos/e null for file-level rejects."""
    v = F.try_parse_json(F.col("value"))
    df = files.select("file", v.alias("v"))
    t = _type(F.col("v"))
    arr = F.try_variant_get(F.col("v"), "$", "array<variant>")
    if spec.wrapper_keys:
        wrapped = F.lit(None).cast("array<variant>")
        for k in reversed(spec.wrapper_keys):
            a = F.try_variant_get(F.col("v"), f"$.{k}", "array<variant>")
            wrapped = F.when(F.coalesce(F.array_size(a), F.lit(0)) > 0, a).otherwise(wrapped)
        wrapped = F.coalesce(wrapped, F.array().cast("array<variant>"))
        arr = F.when(t.startswith("OBJECT"), wrapped).otherwise(arr)
    err = (F.when(F.col("v").isNull(), F.lit("unparseable"))
           .when(F.col("_arr").isNull(), F.lit("not_an_array")))
    df = df.withColumn("_arr", arr).withColumn("file_error", err)
    # One pass: a file without elements gives one row, kept only as its error.
    return (df.select("file", F.posexplode_outer("_arr").alias("pos", "e"), "file_error")
            .filter(F.col("pos").isNotNull() | F.col("file_error").isNotNull()))


def parse_rows(elems: DataFrame, platform, as_of) -> DataFrame:
    """``(file, pos, e[, file_error])`` elements to one row each: the record
    columns, ``file``, ``pos``, ``platform``, ``raw``, and ``reason``, which is
    null for a record and says why for a reject.  Category scores are projected
    once; ``split_rows`` gives records and rejects."""
    spec = get_platform(platform)
    if "file_error" not in elems.columns:
        elems = elems.withColumn("file_error", F.lit(None).cast("string"))
    e = F.col("e")
    t = _type(e)
    is_str = t == "STRING"
    is_obj = t.startswith("OBJECT")
    text_obj, bad_text = _first_truthy(e, spec.text_keys)
    time_obj, _ = _first_truthy(e, spec.time_keys)
    text = F.when(is_str, F.try_variant_get(e, "$", "string")).otherwise(F.coalesce(text_obj, F.lit("")))
    content = strip(text)
    reason = (F.when(F.col("file_error").isNotNull(), F.col("file_error"))
              .when(is_str & F.lit(not spec.accept_strings), F.lit("wrong_element_type"))
              .when(~(is_str | is_obj), F.lit("wrong_element_type"))
              .when(is_obj & bad_text, F.lit("bad_text_type"))
              .when(content == "", F.lit("blank")))
    created = F.when(is_obj, parse_ts(time_obj, as_of)).otherwise(ts_lit(as_of))
    staged = elems.select("file", F.col("pos").cast("bigint").alias("pos"), F.to_json(e).alias("raw"), content.alias("content"),
                          reason.alias("reason"), created.alias("created_at"))
    rid = F.sha2(F.concat_ws("|", F.lit(spec.name), F.col("file"), F.col("pos").cast("string"),
                             F.col("content")), 256)
    scored = classify_frame(staged, spec)
    return scored.select(
        rid.alias("id"), "content", F.lit(spec.name).alias("source"), "category",
        extract_tags(F.col("content"), spec).alias("tags"),
        F.lit(False).alias("sensitive"), F.lit(float(spec.confidence)).alias("confidence"),
        "created_at", F.col("created_at").alias("updated_at"), F.col("content").alias("source_raw"),
        "file", "pos", F.lit(spec.name).alias("platform"), "reason", "raw")


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of ``parse_rows``."""
    return (rows.filter(F.col("reason").isNull()).drop("platform", "reason", "raw"),
            rows.filter(F.col("reason").isNotNull()).select(*REJECT_COLUMNS))


def parse_elements(elems: DataFrame, platform, as_of) -> tuple[DataFrame, DataFrame]:
    return split_rows(parse_rows(elems, platform, as_of))


def read_exports(spark: SparkSession, path: str, platform: PlatformSpec | str = "chatgpt",
                 as_of=None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` from export files at ``path``.

    ``records`` has the record columns plus ``file`` and ``pos`` (input order,
    used for first-wins de-duplication); ``rejects`` is
    ``(file, pos, platform, reason, raw)``.
    """
    import datetime as _dt
    spec = get_platform(platform)
    as_of = as_of or _dt.datetime.now(_dt.timezone.utc)
    if lines:
        # A large file is read in splits: a line's place is its split's place in
        # the file (in steps of 64 KB), then its number in the task.
        place = (F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 16), 36)
                 + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        el = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), place.alias("pos"),
            F.try_parse_json("value").alias("e"))
        el = el.withColumn("file_error", F.when(F.col("e").isNull(), F.lit("unparseable")))
        return parse_elements(el, spec, as_of)
    return parse_elements(_elements(read_export_files(spark, path), spec), spec, as_of)


def record_columns(df: DataFrame) -> DataFrame:
    return df.select(*RECORD_COLUMNS)


def ingest_summary(rows: DataFrame) -> DataFrame:
    """S7 from ``parse_rows``: ``(metric, key, value)``: parsed, skipped, then
    categories by count (``rank`` orders them, most common first).  One
    aggregate over the parsed rows."""
    from pyspark.sql import Window
    counts = rows.groupBy(F.col("reason").isNull().alias("ok"), F.when(F.col("reason").isNull(), F.col("category")).alias("category")) \
        .agg(F.count(F.lit(1)).alias("n"))
    row = lambda name, key: F.struct(F.lit(name).alias("metric"), key.alias("key"), F.col("n").alias("value"))
    none = F.lit(None).cast("string")
    each = F.when(F.col("ok"), F.array(row("parsed", none), row("category", F.col("category")))).otherwise(F.array(row("skipped", none)))
    zero = F.array(*[F.struct(F.lit(m).alias("metric"), none.alias("key"), F.lit(0).cast("bigint").alias("value")) for m in ("parsed", "skipped")])
    found = counts.select(F.inline(each)).unionByName(rows.sparkSession.range(1).select(F.inline(zero)))
    found = found.groupBy("metric", "key").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col("key"))
    return found.withColumn("rank", F.when(F.col("metric") == "category", F.row_number().over(w)).otherwise(F.lit(0)))


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Skipped rows per platform and reason."""
    return rejects.groupBy("platform", "reason").agg(F.count(F.lit(1)).alias("n"))


def parse_document_rows(docs: DataFrame, platform: PlatformSpec | str = "chatgpt", as_of=None,
                        file_col: str = "file", text_col: str = "value", lines: bool = False) -> DataFrame:
    """S1-S5 for export documents already held in a table column (one JSON
    document per row, e.g. landed from a message queue) as ``parse_rows``;
    ``lines``: a document is JSON Lines, one element a line."""
    import datetime as _dt
    spec = get_platform(platform)
    as_of = as_of or _dt.datetime.now(_dt.timezone.utc)
    files = docs.select(F.col(file_col).cast("string").alias("file"), F.col(text_col).alias("value"))
    if lines:
        el = files.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line")).filter(F.trim("line") != "")
        el = el.select("file", "pos", F.try_parse_json("line").alias("e"))
        return parse_rows(el.withColumn("file_error", F.when(F.col("e").isNull(), F.lit("unparseable"))), spec, as_of)
    return parse_rows(_elements(files, spec), spec, as_of)


def parse_documents(docs: DataFrame, platform: PlatformSpec | str = "chatgpt", as_of=None, file_col: str = "file",
                    text_col: str = "value", lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of ``parse_document_rows``."""
    return split_rows(parse_document_rows(docs, platform, as_of, file_col, text_col, lines))

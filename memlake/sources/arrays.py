"""Large exports: one JSON array of any size, read in splits.

``read_exports`` takes a file as one row.  Here a file is read as text cut at
commas, by as many tasks as it has splits.  Elements of the array end at the
commas outside strings at depth one, so an element is some pieces in a row.
Whether a piece starts in a string, and how deep, is a running sum:

1. in each split: the parity of quotes before a piece, and the change of depth
   for both cases, of a split that starts outside and one that starts inside a string;
2. over the splits of a file (one row each): where each starts;
3. in each split: the number of elements that ended before a piece; the pieces of
   an element are joined, and once more across splits.

A task holds pieces of one split, never a file.  An element is one row, as it is
for every reader.

Defined cases: an empty array has no elements; a file that does not begin with
``[`` is one reject ``not_an_array`` (wrapper objects are for ``read_exports``), and one
that is empty, cut off, or goes on behind the array is one reject ``unparseable``
(``read_exports`` passes over what follows an array); an element that is no JSON is
a reject of its own (``read_exports`` rejects the file then); compressed files are one split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.sources.exports import parse_elements
from memlake.util import drop_materialized, materialize

_SPLIT = ["file", "block"]


def _depth(text):
    """Opened less closed brackets outside the strings of ``text``, which starts outside one."""
    bare = F.regexp_replace(text, r'"[^"]*("|\z)', "")
    return F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, piece, odd, out, inside): pieces with, from the start of
    their split, the parity of quotes to their end, and the depth at their end if the split
    starts outside or inside a string."""
    df = spark.read.text(path, lineSep=",").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("n"), F.col("value").alias("piece"))
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    df = df.withColumn("quotes", F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit(""))))
    df = df.withColumn("d_out", _depth(plain)).withColumn("d_in", _depth(F.regexp_replace(plain, r'^[^"]*("|\z)', "")))
    so_far = Window.partitionBy(*_SPLIT).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("seen", F.sum("quotes").over(so_far))
    began_in = (F.col("seen") - F.col("quotes")) % 2 == 1
    return df.select(*_SPLIT, "n", "piece", (F.col("seen") % 2).alias("odd"),
                     F.sum(F.when(began_in, F.col("d_in")).otherwise(F.col("d_out"))).over(so_far).alias("out"),
                     F.sum(F.when(began_in, F.col("d_out")).otherwise(F.col("d_in"))).over(so_far).alias("inside"))


def _entries(pieces: DataFrame) -> DataFrame:
    """(file, block, entered, depth, first, whole): where each split starts, whether it
    is its file's first, and whether the file ends outside strings at depth 0."""
    last = pieces.groupBy(*_SPLIT).agg(F.max_by(F.struct("odd", "out", "inside"), "n").alias("end"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")
    df = last.withColumn("entered", F.coalesce(F.sum("end.odd").over(before), F.lit(0)) % 2)
    df = df.withColumn("change", F.when(F.col("entered") == 1, F.col("end.inside")).otherwise(F.col("end.out")))
    df = df.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    return df.select(*_SPLIT, "entered", "depth", (F.col("block") == F.min("block").over(every)).alias("first"),
                     ((F.sum("end.odd").over(every) % 2 == 0) & (F.sum("change").over(every) == 0)).alias("whole"))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, value, file_error)`` of the files at ``path``, a written table
    (``drop_materialized`` removes it): the text of each element, or a row without
    ``pos`` for a file that is no array."""
    pieces = materialize(_pieces(spark, path), "array-pieces")
    df = pieces.join(_entries(pieces), _SPLIT)
    depth = F.col("depth") + F.when(F.col("entered") == 1, F.col("inside")).otherwise(F.col("out"))
    ends = ((F.col("odd") + F.col("entered")) % 2 == 0) & (depth == 1)
    earlier = Window.partitionBy(*_SPLIT).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("ends", ends.cast("long")).withColumn("k", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), ",")
    parts = materialize(df.groupBy(*_SPLIT, "k").agg(joined.alias("text"), F.sum("ends").alias("ends"), F.first("whole").alias("whole")),
                        "array-parts")
    drop_materialized(pieces)

    counts = parts.groupBy(*_SPLIT).agg(F.sum("ends").alias("ended"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*_SPLIT, F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("base"),
                           F.sum("ended").over(Window.partitionBy("file")).alias("last"))
    parts_at = parts.join(counts, _SPLIT).withColumn("pos", F.col("base") + F.col("k"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), ",")
    found = parts_at.groupBy("file", "pos").agg(text.alias("text"), F.first("whole").alias("whole"), F.first("last").alias("last"))

    # The array's own brackets: at the start of its first element, at the end of its last.
    opened, closed = F.col("text").rlike(r"^\s*\["), F.col("text").rlike(r"\]\s*\z")
    found = found.withColumn("error", F.when((F.col("pos") == 0) & F.col("text").rlike(r"^\s*\z"), "unparseable")
                             .when((F.col("pos") == 0) & ~opened, "not_an_array")
                             .when((F.col("pos") == F.col("last")) & ~(closed & F.col("whole")), "unparseable"))
    found = found.withColumn("text", F.when(F.col("pos") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text")))
    found = found.withColumn("text", F.when(F.col("pos") == F.col("last"), F.regexp_replace("text", r"\]\s*\z", "")).otherwise(F.col("text")))
    found = materialize(found.where(~((F.col("last") == 0) & F.col("error").isNull() & F.col("text").rlike(r"^\s*\z"))), "array-elements")
    drop_materialized(parts)
    bad = found.where("error is not null").groupBy("file").agg(F.min("error").alias("file_error"))
    good = found.join(bad.select("file"), "file", "left_anti").select("file", "pos", F.col("text").alias("value"), F.lit(None).cast("string").alias("file_error"))
    none = F.lit(None)
    out = good.unionByName(bad.select("file", none.cast("long").alias("pos"), none.cast("string").alias("value"), "file_error"))
    out._materialized_at = found._materialized_at
    return out


def parse_array_elements(elements: DataFrame, platform, as_of) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of ``array_elements``."""
    e = F.try_parse_json("value")
    error = F.coalesce("file_error", F.when(e.isNull(), F.lit("unparseable")))
    return parse_elements(elements.select("file", "pos", e.alias("e"), error.alias("file_error")), platform, as_of)

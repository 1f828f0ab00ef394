"""Ranked full-text search (Q1-Q6, Q8).

Index (Q1-Q3): content and tag text are split into ASCII-folded tokens.  One
positional table answers every kind of query::

    postings (…by, term, id, tf, content_at, tags_at)   one row per term and row
    lengths  (…by, id, dl, created_at)                  tokens of both fields
    terms    (…by, term, n_t)                           rows holding the term
    stats    (…by, n_rows, total_tokens, avgdl)

``by`` holds owner columns: each owner's rows are a corpus of their own.  The
index is built once and materialised (``write_index`` keeps it across jobs);
queries run no job of their own before the action.  A row's tokens (or stems)
become postings in the task that holds the row.  A query without an index
builds its own and writes its hits, so that the index is gone when it returns.

A query is a set of *units*: a term, a phrase (consecutive tokens of one field),
a prefix (its expansions count as one term), each in one field or both.  A unit
of several tokens, a prefix or a field gets postings and a row count of its own;
from there on every unit is scored like a term:

1. the rarest required unit of each query seeds the candidates (all its
   alternatives if it has no required unit), and its postings are hits already;
2. candidates are expanded with the units that can still change the score (of a
   query without required units: the excluded ones) and joined to the postings
   on ``(term, id)``, so a very common term never fans out per query;
3. BM25 per unit (k1 = 1.2, b = 0.75, idf floored at 1e-6) is summed with the
   unit's repeat count; a ranked window keeps the top ``limit`` per query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.places import row_postings
from memlake.functions.scores import row_scores, unit_hits
from memlake.functions.stemming import with_stems
from memlake.functions.text import fts_tokens
from memlake.operators.rules import Rules, exclude
from memlake.util import drop_materialized, materialize

K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
FIELDS = ("content", "tags")
#: Prefixes are looked up by their first characters, at most this many.
PREFIX_KEY = 6
#: Files of a stored index, by term hash.
BUCKETS = 64
#: Of a search for every hit: units that a task holds at most; hits of a group of rows, about, and groups at least.
UNITS, HITS, LEAST = 1 << 20, 1 << 21, 16

# Query validity for the ranked route (Q6): barewords only -- ASCII letters,
# digits, underscore, non-ASCII and 0x1A -- separated by whitespace, and no
# upper-case operator word used where it cannot stand.
BAREWORD = r"[A-Za-z0-9_\x{80}-\x{10FFFF}\x{1a}]+"
VALID_QUERY = rf"^\s*{BAREWORD}(\s+{BAREWORD})*\s*$"
OPERATORS = ("AND", "OR", "NOT", "NEAR")

_NO_WORDS = "cast(array() as array<string>)"


@dataclass
class TextIndex:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame
    stemmed: bool
    by: list[str] = field(default_factory=list)

    def drop(self) -> None:
        """Delete the index's tables (of an index built here, not a stored one)."""
        drop_materialized(self.postings, self.lengths, self.terms, self.stats)


def _field_text(name: str):
    return F.col("content") if name == "content" else F.array_join(F.col("tags"), " ")


def tokens(df: DataFrame, fields=FIELDS, by=()) -> DataFrame:
    """Q1: ``(…by, id, field, pos, term)`` for content and tags, in one scan."""
    def placed(name):
        return F.transform(fts_tokens(F.coalesce(_field_text(name), F.lit(""))), lambda t, i: F.struct(
            F.lit(name).alias("field"), i.alias("pos"), t.alias("term")))
    every = F.concat(*[placed(f) for f in fields])
    return df.select(*by, "id", F.inline(every))


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """Q2: ``(term, stem)`` for the distinct terms."""
    return with_stems(terms.select("term").distinct())


def _postings(df: DataFrame, stem: bool, fields, by: list[str]) -> DataFrame:
    """Each row's tokens become postings where the row is.  Only rows that
    share their id, parts of one text, are grouped by Spark."""
    keys = [*by, "id"]
    rows = df.select(*keys, *[(F.col("content") if f == "content" else _field_text(f)).alias(f) for f in fields])
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in keys])
    again = materialize(again, "repeated-ids")
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "term string", "tf bigint", *[f"{f}_at array<int>" for f in fields]])
    cols = [*by, "term", "id", "tf", *[(F.col(f"{f}_at") if f in fields else F.array().cast("array<int>").alias(f"{f}_at")) for f in FIELDS]]

    def made(part):
        # Dealt by id as texts, whatever the files are like.
        return part.repartition(*keys).mapInArrow(row_postings(keys, list(fields), stem), schema).select(*cols)
    if not again.limit(1).count():
        out = materialize(made(rows), "postings")
    else:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        parts = made(rows.join(again, same, "left_semi")).groupBy(*by, "term", "id").agg(F.sum("tf").alias("tf"), *[
            F.sort_array(F.flatten(F.collect_list(f"{f}_at"))).alias(f"{f}_at") for f in FIELDS])
        out = materialize(made(rows.join(again, same, "left_anti")).unionByName(parts), "postings")
    drop_materialized(again)
    return out


def _index(postings: DataFrame, rows: DataFrame, stem: bool, by: list[str]) -> TextIndex:
    """Lengths and statistics of postings; ``rows``: (…by, id, created_at)."""
    # Rows without any token still count in N with length 0.
    none = F.lit(0).cast("bigint")
    dl = (postings.select(*by, "id", F.col("tf").alias("dl"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(False).alias("row"))
          .unionByName(rows.select(*by, "id", none.alias("dl"), "created_at", F.lit(True).alias("row"))))
    lengths = materialize(dl.groupBy(*by, "id").agg(F.sum("dl").alias("dl"), F.max("created_at").alias("created_at"),
                                                    F.max("row").alias("row")).where("row").drop("row"), "lengths")
    stats = lengths.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("dl").alias("total_tokens"))
    stats = materialize(stats.withColumn("avgdl", F.col("total_tokens") / F.col("n_rows")), "stats")
    terms = materialize(postings.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n_t")), "terms")
    return TextIndex(postings, lengths, terms, stats, stem, by)


def build_index(df: DataFrame, stem: bool = True, fields=FIELDS, by=()) -> TextIndex:
    """Q3: postings, row lengths, term and corpus statistics, materialised."""
    by = list(by)
    return _index(_postings(df, stem, fields, by), df.select(*by, "id", "created_at"), stem, by)


def extend_index(index: TextIndex, added: DataFrame) -> TextIndex:
    """The index with ``added`` rows (new ids) included."""
    by = index.by
    new = _postings(added, index.stemmed, FIELDS, by)
    rows = index.lengths.select(*by, "id", "created_at").unionByName(added.select(*by, "id", "created_at"))
    return _index(materialize(index.postings.unionByName(new), "postings"), rows, index.stemmed, by)


def shrink_index(index: TextIndex, removed: DataFrame) -> TextIndex:
    """The index without the rows whose ``id`` is in ``removed``; a changed
    row is removed and then added again."""
    ids = removed.select(*index.by, "id")
    keys = [*index.by, "id"]
    return _index(materialize(index.postings.join(ids, keys, "left_anti"), "postings"),
                  index.lengths.join(ids, keys, "left_anti"), index.stemmed, index.by)


def amend_index(index: TextIndex, added: DataFrame, removed: DataFrame) -> TextIndex:
    """The index without the rows whose ``id`` is in ``removed`` and with
    ``added`` (a changed row is in both).  The tables of ``index`` are not
    rewritten: what was added, and the change of the term counts, are small
    tables beside them, united when they are read.  ``extend_index`` and
    ``shrink_index`` write the whole again, for when many changes have gathered."""
    by, keys = index.by, [*index.by, "id"]
    gone = materialize(removed.select(*keys).distinct(), "gone")
    new = _index(_postings(added, index.stemmed, FIELDS, by), added.select(*keys, "created_at"), index.stemmed, by)

    def lost(table):
        return table.join(gone, keys, "left_semi")
    change = new.terms.unionByName(lost(index.postings).groupBy(*by, "term").agg((-F.count(F.lit(1))).alias("n_t")))
    change = materialize(change, "term-changes")
    terms = index.terms.unionByName(change).groupBy(*by, "term").agg(F.sum("n_t").alias("n_t")).where("n_t > 0")
    sizes = new.stats.select(*by, "n_rows", "total_tokens").unionByName(
        lost(index.lengths).groupBy(*by).agg((-F.count(F.lit(1))).alias("n_rows"), (-F.sum("dl")).alias("total_tokens")))
    sizes = materialize(sizes, "size-changes")
    stats = index.stats.select(*by, "n_rows", "total_tokens").unionByName(sizes).groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("total_tokens").alias("total_tokens")).where("n_rows > 0")
    stats = stats.withColumn("avgdl", F.col("total_tokens") / F.col("n_rows"))
    return TextIndex(index.postings.join(gone, keys, "left_anti").unionByName(new.postings),
                     index.lengths.join(gone, keys, "left_anti").unionByName(new.lengths), terms, stats, index.stemmed, by)


def write_index(index: TextIndex, path: str) -> None:
    """Store an index; postings and terms lie in ``BUCKETS`` folders by term
    hash, sorted by term inside, so a lookup of few terms reads few row groups
    (``read_index(terms=...)``)."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    for name in ("postings", "terms"):
        (getattr(index, name).withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term")
         .write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/{name}"))
    index.lengths.write.mode("errorifexists").parquet(f"{path}/lengths")
    index.stats.write.mode("errorifexists").parquet(f"{path}/stats")


def read_index(spark, path: str, stem: bool = True, by=(), terms: list[str] | None = None) -> TextIndex:
    """A stored index; ``terms`` (as indexed) limits it to their buckets and
    row groups, enough for queries of those terms."""
    def table(name):
        df = spark.read.parquet(f"{path}/{name}")
        if terms is not None and "bucket" in df.columns:
            wanted = [r["b"] for r in spark.createDataFrame([(t,) for t in terms], "term string")
                      .select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
            df = df.where(F.col("bucket").isin(wanted) & F.col("term").isin(list(terms)))
        return df.drop("bucket")
    return TextIndex(table("postings"), table("lengths"), table("terms"), table("stats"), stem, list(by))


# ------------------------------------------------------------------- units --

def _bm25(tf, dl, avgdl, n_rows, n_t) -> F.Column:
    idf = F.greatest(F.log((n_rows - n_t + 0.5) / (n_t + 0.5)), F.lit(IDF_FLOOR))
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def _with_stats(df: DataFrame, index: TextIndex) -> DataFrame:
    """Attach the corpus statistics (a scalar, or one row per owner)."""
    if index.by:
        return df.join(index.stats.select(*index.by, "n_rows", "avgdl"), index.by)
    return df.withColumn("n_rows", index.stats.select("n_rows").scalar()) \
             .withColumn("avgdl", index.stats.select("avgdl").scalar())


def _stemmed_tokens(units: DataFrame, keys: list[str]) -> DataFrame:
    """``units`` with the stems of their tokens."""
    each = units.select(*units.columns, F.posexplode("tokens").alias("i", "term"))
    each = each.join(stem_vocabulary(each), "term")
    rest = [c for c in units.columns if c != "tokens"]
    back = each.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct("i", "stem"))).alias("t"))
    return back.select(*rest, F.transform("t", lambda x: x["stem"]).alias("tokens"))


def _units(queries: DataFrame, index: TextIndex, keys: list[str], lists: dict[str, tuple[str, bool, bool]]) -> DataFrame:
    """``(…keys, …by, role, tokens, prefix, field)``; ``lists`` maps a column
    of texts to (role, prefix, whether a text stays one unit)."""
    by = index.by
    scope = F.col("field") if "field" in queries.columns else F.lit(None).cast("string")

    def listed(name, role, prefix, whole):
        toks = F.flatten(F.transform(F.coalesce(F.col(name), F.expr(_NO_WORDS)),
                                     lambda x: F.array(fts_tokens(x)) if whole else F.transform(fts_tokens(x), lambda t: F.array(t))))
        return F.transform(toks, lambda t: F.struct(F.lit(role).alias("role"), t.alias("tokens"), F.lit(prefix).alias("prefix")))

    parts = [listed(name, *how) for name, how in lists.items()]
    units = queries.select(*keys, *[c for c in by if c not in keys], scope.alias("field"), F.explode(F.concat(*parts)).alias("u"))
    units = units.select(*[c for c in units.columns if c != "u"], "u.*").where(F.size("tokens") > 0)
    if index.stemmed:
        units = units.withColumn("n", F.monotonically_increasing_id())
        units = _stemmed_tokens(units, keys).drop("n")
    return units


def _expansions(index: TextIndex, tokens: DataFrame) -> DataFrame:
    """``(…tokens, term, n_t)``: the terms that start with ``token``, met in
    the vocabulary by their first characters."""
    by = index.by
    heads = F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(PREFIX_KEY))), lambda n: F.substring(F.col("term"), F.lit(1), n))
    keyed = index.terms.select("*", F.explode(heads).alias("head"))
    met = tokens.withColumn("head", F.substring("token", 1, PREFIX_KEY)).join(keyed, [*by, "head"])
    return met.where(F.startswith("term", "token")).drop("head")


def _placed(name: str, shift=None) -> F.Column:
    """Places of a field, if the unit asks for that field (null: for both)."""
    wanted = F.col("field").isNull() | (F.col("field") == name)
    at = F.col(f"{name}_at") if shift is None else F.transform(f"{name}_at", lambda p: p - shift)
    return F.when(wanted, at).otherwise(F.array().cast("array<int>"))


def _held(postings: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """The postings of some terms, so that no others are shuffled."""
    return postings.join(terms.select(*by, "term").distinct(), [*by, "term"], "left_semi")


def _unit_hits(index: TextIndex, units: DataFrame, every: bool = False) -> DataFrame:
    """``(…by, term, id, tf)`` of the units that are no plain term, written,
    under a term of their own.  A unit of one token counts the places of its terms:
    one join with the postings, as large as the postings that it holds, or (in a
    search for ``every`` hit, without owners) where the postings are read.  A
    phrase is found by its rarest whole token; the others, and a prefix at its
    end (the places of all its terms, united once a prefix), are looked up in
    the rows found, and the starts that all of them agree on are counted."""
    by, postings = index.by, index.postings
    kinds = units.where("not plain").select(*by, "term", "tokens", "prefix", "field").distinct().withColumnRenamed("term", "unit")
    one = kinds.where(F.size("tokens") == 1).select(*by, "unit", "field", "prefix", F.col("tokens")[0].alias("token"))
    tf = sum((F.size(_placed(f)) for f in FIELDS), F.lit(0))
    if not by and every and one.count() <= UNITS:
        # Where the postings are: their tokens are few, the terms that a prefix expands to are not.
        known = None
        asked = one.toArrow()
        counted = postings.select("id", "term", *[F.size(f"{f}_at").alias(f) for f in FIELDS]).mapInArrow(
            unit_hits(asked, list(FIELDS)), f"term string, id {dict(postings.dtypes)['id']}, tf bigint") if asked.num_rows else None
        singles = one.sparkSession.createDataFrame([], f"term string, id {dict(postings.dtypes)['id']}, tf bigint") if counted is None else \
            counted.groupBy("term", "id").agg(F.sum("tf").alias("tf"))
    else:
        known = one.where("not prefix").select(*by, "unit", "field", F.col("token").alias("term")).unionByName(
            _expansions(index, one.where("prefix")).select(*by, "unit", "field", "term"))
        known = materialize(known, "unit-terms")
        held = known.join(_held(postings, known, by).drop("tf"), [*by, "term"])
        singles = held.groupBy(*by, F.col("unit").alias("term"), "id").agg(F.sum(tf).cast("bigint").alias("tf")).where("tf > 0")

    many = kinds.where(F.size("tokens") > 1).select(*by, "unit", "field", "prefix", F.size("tokens").alias("k"), F.posexplode("tokens").alias("i", "token"))
    last = F.col("prefix") & (F.col("i") == F.col("k") - 1)
    whole = many.where(~last).withColumn("whole", F.col("k") - F.col("prefix").cast("int")).withColumnRenamed("token", "term")
    whole = whole.join(index.terms, [*by, "term"])
    rarest = whole.groupBy(*by, "unit").agg(F.min(F.struct("n_t", "i"))["i"].alias("rare"), F.count(F.lit(1)).alias("found"))
    whole = materialize(whole.join(rarest, [*by, "unit"]).where("found = whole"), "unit-tokens")
    cols = [*by, "unit", "field", "k", "i", "id"]
    seeds = whole.where("i = rare").join(_held(postings, whole.where("i = rare"), by), [*by, "term"]).select(*cols, *[f"{f}_at" for f in FIELDS])
    rows = seeds.select(*by, "unit", "id")
    others = rows.join(whole.where("i <> rare"), [*by, "unit"]).join(
        _held(postings, whole.where("i <> rare"), by), [*by, "term", "id"]).select(*seeds.columns)
    ends = many.where(last)
    grown = materialize(_expansions(index, ends.select(*by, "token").distinct()), "unit-ends")
    spread = grown.join(_held(postings, grown, by), [*by, "term"]).groupBy(*by, "token", "id").agg(
        *[F.flatten(F.collect_list(f"{f}_at")).alias(f"{f}_at") for f in FIELDS])
    ends = rows.join(ends, [*by, "unit"]).join(spread, [*by, "token", "id"]).select(*seeds.columns)
    at = seeds.unionByName(others).unionByName(ends)

    # A start counts if every token of the unit stands at its place behind it.
    starts = at.select(*by, "unit", "id", "k", *[_placed(f, F.col("i")).alias(f) for f in FIELDS])
    full = starts.groupBy(*by, "unit", "id", "k").agg(*[F.sort_array(F.flatten(F.collect_list(f))).alias(f) for f in FIELDS])

    def agreed(name):
        def first_of_k(x, i):
            def other(j):
                return ~F.coalesce(F.get(F.col(name), j) == x, F.lit(False))
            return other(i - 1) & ~other(i + F.col("k") - 1) & other(i + F.col("k"))
        return F.size(F.filter(name, first_of_k))
    phrases = full.select(*by, F.col("unit").alias("term"), "id", sum((agreed(f) for f in FIELDS), F.lit(0)).cast("bigint").alias("tf")).where("tf > 0")
    out = materialize(singles.unionByName(phrases), "unit-hits")
    drop_materialized(whole, grown, *([known] if known is not None else []))
    return out


def _named(units: DataFrame) -> DataFrame:
    """Units with ``plain`` and the ``term`` they are counted under."""
    plain = (F.size("tokens") == 1) & ~F.col("prefix") & F.col("field").isNull()
    name = F.when(plain, F.col("tokens")[0]).otherwise(F.concat(F.lit("\u0000"), F.sha2(F.to_json(F.struct("tokens", "prefix", "field")), 256)))
    return units.withColumn("plain", plain).withColumn("term", name)


def _every_hit(index: TextIndex, known: DataFrame, postings: DataFrame, scope: list[str]) -> DataFrame | None:
    """``_scored`` of all rows: what is asked of a row meets in the task that has
    the row, once a unit and not once a query, and all queries are scored there by
    the table of their units.  None if that is too large for a task, or empty."""
    by, keys = index.by, [*index.by, "id"]
    if not 0 < known.count() <= UNITS:
        return None
    numbers = materialize(known.select(*by, "term").distinct().withColumn("number", F.monotonically_increasing_id()), "unit-numbers")
    idf = F.greatest(F.log((F.col("n_rows") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5)), F.lit(IDF_FLOOR))
    units = _with_stats(known, index).join(numbers, [*by, "term"]).select(
        *scope, "number", "term", "role", "repeats", "n_all", "n_any", "n_t", idf.alias("idf"), "avgdl").toArrow()
    size = sum(units.column("n_t").to_pylist())
    rows = postings.join(numbers, [*by, "term"]).select(*keys, "number", F.col("tf").cast("bigint").alias("tf"), F.lit(None).cast(
        index.lengths.schema["created_at"].dataType).alias("created_at"))
    rows = rows.unionByName(index.lengths.select(*keys, F.lit(-1).cast("bigint").alias("number"), F.col("dl").cast("bigint").alias("tf"), "created_at"))
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    bucket = F.pmod(F.xxhash64(*keys), F.lit(max(LEAST, size // HITS))).cast("int")
    types = dict([*index.lengths.dtypes, *known.dtypes])
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in [*scope, "id"]], "score double", f"created_at {types['created_at']}"])
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(row_scores(units, scope, by, K1, B), schema)


def _scored(index: TextIndex, units: DataFrame, scope: list[str], hits: DataFrame | None, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy their query, with scores: ``(…scope, id, score,
    created_at)``, and the table of units that this reads.  Roles: ``all`` units
    must occur, one ``any`` unit must if there is one, ``none`` units must not; a
    query without ``all`` and ``any`` units matches nothing.  ``every``: no top of
    the ranking is cut off, so the rows of every hit are looked at anyway."""
    by = index.by
    terms, postings = index.terms, index.postings.select(*by, "term", "id", "tf")
    if hits is not None:
        terms = terms.unionByName(hits.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n_t")))
        postings = postings.unionByName(hits)
    wanted = units.groupBy(*scope, "role", "term").agg(F.count(F.lit(1)).cast("bigint").alias("repeats"))
    need = wanted.groupBy(*scope).agg(F.count_if(F.col("role") == "all").alias("n_all"), F.count_if(F.col("role") == "any").alias("n_any"))
    known = wanted.join(terms, [*by, "term"])
    # A required unit that no row holds leaves its query without candidates.
    seeds = known.groupBy(*scope).agg(
        F.count_if(F.col("role") == "all").alias("known_all"),
        F.min(F.when(F.col("role") == "all", F.struct("n_t", "term"))).alias("rare"))
    seeds = seeds.join(need, scope).where("known_all = n_all").select(*scope, "n_all", "n_any", F.col("rare")["term"].alias("rare"))
    # A few rows a query, read three times below.
    known = table = materialize(known.join(seeds, scope), "units")
    scored = _every_hit(index, known, postings, scope) if every else None
    if scored is not None:
        return scored, table
    is_seed = F.when(F.col("n_all") > 0, (F.col("role") == "all") & (F.col("term") == F.col("rare"))).otherwise(F.col("role") == "any")
    found = known.where(is_seed).join(postings, [*by, "term"])
    rows = found.select(*scope, "id").distinct()
    further = known.where(~is_seed & ((F.col("n_all") > 0) | (F.col("role") == "none")))
    looked_up = rows.join(further, scope).join(_held(postings, further, by), [*by, "term", "id"])
    matched = found.unionByName(looked_up.select(*found.columns))
    per_row = matched.groupBy(*scope, "id", "n_all", "n_any").agg(
        F.count_if(F.col("role") == "all").alias("got_all"), F.count_if(F.col("role") == "any").alias("got_any"),
        F.count_if(F.col("role") == "none").alias("got_none"),
        F.collect_list(F.when(F.col("role") != "none", F.struct("term", "tf", "n_t", "repeats"))).alias("_t"))
    full = per_row.where("got_all = n_all and got_none = 0 and (n_any = 0 or got_any > 0)")
    full = _with_stats(full.join(index.lengths, [*by, "id"]), index)
    # Summed in term order, so equal rows get bit-identical scores whatever
    # order the shuffle delivered their terms in (ties then fall to newest).
    score = F.aggregate(F.sort_array("_t"), F.lit(0.0).cast("double"),
                        lambda acc, x: acc + x["repeats"] * _bm25(x["tf"], F.col("dl"), F.col("avgdl"), F.col("n_rows"), x["n_t"]))
    return full.select(*scope, "id", score.alias("score"), "created_at"), table


def top_k(scored: DataFrame, limit: int | None, keys: list[str]) -> DataFrame:
    """Rank ``(…keys, id, score, created_at)`` by score desc, newest, id; keep ``limit``."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("created_at").desc(), F.col("id").asc())
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= limit) if limit is not None else out


# ----------------------------------------------------------------- queries --

def _hits(df: DataFrame | None, index: TextIndex | None, stem: bool, by, keys: list[str], units, limit: int | None, narrow=None) -> DataFrame:
    """The first ``limit`` hits of ``units(index)``, written; what they were
    made from, an index built here included, is dropped."""
    own = index is None
    index = build_index(df, stem=stem, by=by) if own else index
    scope = [*keys, *[c for c in index.by if c not in keys]]
    asked = materialize(_named(units(index)), "asked")
    # Read from the table of the queries' units: plain terms need no hits of their own.
    special = _unit_hits(index, asked, limit is None) if asked.where("not plain").limit(1).count() else None
    scored, known = _scored(index, asked, scope, special, limit is None)
    out = materialize(top_k(narrow(scored) if narrow else scored, limit, scope), "hits")
    drop_materialized(asked, known, *([special] if special is not None else []))
    if own:
        index.drop()
    return out


def _bag(queries: DataFrame, index: TextIndex, query_col: str, keys: list[str]) -> DataFrame:
    """Every token of free query text as a required term."""
    return _units(queries.withColumn("_all", F.array(F.col(query_col))), index, keys, {"_all": ("all", False, False)})


def search(df: DataFrame, queries: DataFrame, limit: int | None = 5, index: TextIndex | None = None,
           stem: bool = True, query_col: str = "query", key_cols=("query_id",), by=()) -> DataFrame:
    """Q4: ``(…keys, …by, id, created_at, score, rank)`` for a table of queries.
    With ``by``, queries carry the owner columns and see their owner's rows."""
    keys = list(key_cols)

    return _hits(df, index, stem, by, keys, lambda i: _bag(queries, i, query_col, keys), limit)


def structured_search(df: DataFrame, queries: DataFrame, limit: int | None = 5, index: TextIndex | None = None,
                      stem: bool = True, key_cols=("query_id",), by=()) -> DataFrame:
    """Q5: queries with array columns, each optional, null or empty, all of
    them combined: ``all_terms``, ``phrases`` and ``prefixes`` must occur, one
    of ``any_terms`` must (if given), ``none_terms`` must not.  A term of
    several tokens is a phrase; a prefix is that of its last token.  ``field``
    (``content`` or ``tags``, null for both) limits every unit of the query."""
    keys = list(key_cols)
    lists = {"all_terms": ("all", False, True), "phrases": ("all", False, True), "prefixes": ("all", True, True),
             "any_terms": ("any", False, True), "none_terms": ("none", False, True)}

    return _hits(df, index, stem, by, keys, lambda i: _units(queries, i, keys, {c: v for c, v in lists.items() if c in queries.columns}), limit)


def phrase_search(df: DataFrame, queries: DataFrame, limit: int | None = 5, index: TextIndex | None = None,
                  stem: bool = True, phrases_col: str = "phrases", key_cols=("query_id",), by=()) -> DataFrame:
    """Q5 phrases: rows containing *every* phrase of the query, each as
    consecutive tokens of one field and scored as one term."""
    keys = list(key_cols)

    return _hits(df, index, stem, by, keys, lambda i: _units(queries, i, keys, {phrases_col: ("all", False, True)}), limit)


def _words(q) -> F.Column:
    return F.filter(F.split(F.trim(q), r"\s+"), lambda w: w != "")


def route_queries(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Q6: add ``mode``: ``ranked`` for bareword queries, else ``keyword``
    (the fallback for text the ranked route cannot take: empty text,
    punctuation, quotes, NEAR, and OR / NOT expressions, whose grammar is not
    parsed here -- ``structured_search`` offers OR / NOT as columns).  An
    upper-case AND between barewords is implicit and allowed.
    Adds ``has_phrase``: some bareword splits into several tokens
    (``snake_case``) and is matched as a phrase."""
    q = F.col(query_col)
    words = _words(q)
    blocked = F.array(*[F.lit(o) for o in OPERATORS if o != "AND"])
    bad_op = (F.arrays_overlap(words, blocked) |
              F.arrays_overlap(F.slice(words, 1, 1), F.array(F.lit("AND"))) |
              F.arrays_overlap(F.slice(words, -1, 1), F.array(F.lit("AND"))))
    ranked = F.coalesce(q.rlike(VALID_QUERY) & ~bad_op, F.lit(False))
    has_phrase = F.exists(words, lambda w: F.size(fts_tokens(w)) > 1)
    return (queries.withColumn("mode", F.when(ranked, "ranked").otherwise("keyword"))
            .withColumn("has_phrase", ranked & has_phrase))


def routed_search(df: DataFrame, queries: DataFrame, limit: int = 5, stem: bool = True, index: TextIndex | None = None,
                  query_col: str = "query", key_cols=("query_id",), by=()) -> DataFrame:
    """Q6 end to end: ranked search for valid queries (a bareword of several
    tokens is a phrase), keyword search (Q7) for the rest;
    ``(…keys, …by, mode, id, created_at, score, rank)``, keyword score as double."""
    from memlake.operators.keyword import keyword_search
    keys = list(key_cols)
    scope = [*keys, *[c for c in (index.by if index is not None else by) if c not in keys]]
    routed = route_queries(queries, query_col)
    ranked_q = routed.filter(F.col("mode") == "ranked").withColumn(
        "_all", F.filter(_words(F.col(query_col)), lambda w: w != "AND"))

    ranked = _hits(df, index, stem, by, keys, lambda i: _units(ranked_q, i, keys, {"_all": ("all", False, True)}), limit)
    cols = [*scope, "mode", "id", "created_at", "score", "rank"]
    kw = keyword_search(df, routed.filter(F.col("mode") == "keyword"), limit, query_col, key_cols, by=index.by if index is not None else by)
    return ranked.withColumn("mode", F.lit("ranked")).select(*cols).unionByName(
        kw.withColumn("mode", F.lit("keyword")).withColumn("score", F.col("score").cast("double")).select(*cols))


def relevant(df: DataFrame, queries: DataFrame, rules: Rules | DataFrame | None = None, limit: int = 5, stem: bool = True,
             index: TextIndex | None = None, query_col: str = "query", key_cols=("query_id",), by=()) -> DataFrame:
    """Q8: ranked hits, exclusion rules (one ``Rules`` value, or a rules table
    per owner), then the top ``limit`` per query.  Rules are applied *below*
    the top-k, so every visible hit can rank."""
    keys = list(key_cols)

    def visible(scored):
        owner = [c for c in by if c in scored.columns] if index is None else index.by
        rec = df.select(*owner, "id", "content", "category", "tags", "sensitive")
        return exclude(scored.join(rec, [*owner, "id"]), rules, *([owner] if isinstance(rules, DataFrame) else []))
    return _hits(df, index, stem, by, keys, lambda i: _bag(queries, i, query_col, keys), limit, visible)

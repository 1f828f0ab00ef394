"""Keyword search (Q7): substring scoring of a batch of queries.

score(query, row) = number of the query's whitespace words (repeats counted)
that occur as substrings of ``lower(content + ' ' + join(tags, ' '))``;
rows with score > 0 rank by score desc, then newest, then id.

A query word holds no whitespace, so it is a substring of the text exactly
when it is a substring of one whitespace token of it.  Query words therefore
meet the *distinct* tokens of the corpus, once each: the substrings of a token
are joined to the words.  Longer tokens are keyed by grams (three characters;
shorter words by all of theirs), a word by the gram that the fewest of them
hold, and the pairs of an equi-join on the gram are checked with ``contains``.
An owner's tokens then keep the words that the owner asks: rows grow with the
tokens, never with owners x words x tokens.

The first ``limit`` rows come from a bound that never loses one.  A row
without any word of a set R scores at most the query's total less the repeats
of R.  Rows that hold a query's rarest words, and the longest rows, are scored
first, whole; the ``limit``-th best of them gives a score s, and R is the rarest
words up to ``MORE`` below the first place where that most falls below s.  Only
rows that hold enough words of R can still rank, so common words are never
joined to their rows: they are looked up in the texts of the candidates.
Everything is DataFrame joins and aggregates.  Tables that grow with the rows
are joined by merging: Parquet files say little about their size in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import WS_RUN, words
from memlake.util import drop_materialized, materialize

GRAM = 3
#: Tokens of at most so many characters are met by their substrings.
SHORT = 16
#: A candidate must hold this many words of R more than the bound alone asks.
MORE = 2


def query_words(queries: DataFrame, query_col: str = "query", key_cols=("query_id",)) -> DataFrame:
    """``(…keys, word, repeats)``: lower-cased whitespace words per query."""
    w = queries.select(*key_cols, F.explode(F.split(F.lower(F.col(query_col)), WS_RUN)).alias("word"))
    return w.filter(F.col("word") != "").groupBy(*key_cols, "word").agg(
        F.count(F.lit(1)).alias("repeats"))


def search_text(df: DataFrame) -> F.Column:
    return F.concat(F.col("content"), F.lit(" "), F.array_join(F.col("tags"), " "))


def _grams(col: str, n) -> F.Column:
    """Distinct substrings of ``n`` characters."""
    last = F.length(col) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col(col), i, n))))


def _at(last) -> F.Column:
    return F.explode(F.sequence(F.lit(1), last))


def matching_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word, token, …)``: the distinct tokens that contain each word, with
    the further columns of ``tokens``."""
    cols = tokens.columns
    parts = tokens.where(F.length("token").between(1, SHORT)).select(*cols, _at(F.length("token")).alias("_i"))
    parts = parts.select(*cols, "_i", _at(F.length("token") - F.col("_i") + 1).alias("_n"))
    parts = parts.select(*cols, "_i", F.col("token").substr(F.col("_i"), F.col("_n")).alias("word"))
    # Of a word's places in a token the first.
    short = parts.join(vocab, "word").where("locate(word, token) = _i")
    held = tokens.where(F.length("token") > SHORT).select(
        *cols, F.explode(F.concat(*[_grams("token", F.lit(n)) for n in range(1, GRAM + 1)])).alias("gram"))
    asked = vocab.select("word", F.explode(_grams("word", F.least(F.length("word"), F.lit(GRAM)))).alias("gram"))
    # Of a word's grams the one that the fewest tokens hold.
    frequency = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = asked.join(frequency, "gram", "left").groupBy("word").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    long = held.join(chosen, "gram").where(F.contains("token", "word"))
    return short.select("word", *cols).unionByName(long.select("word", *cols))


def word_hits(df: DataFrame, vocab: DataFrame, text: F.Column | None = None, by=()) -> DataFrame:
    """``(…by, id, created_at, word)`` for every word of ``vocab`` that occurs
    in a row's search text."""
    by = list(by)
    text = text if text is not None else search_text(df)
    held = df.select(*by, "id", "created_at", F.explode(F.array_distinct(words(text))).alias("token"))
    pairs = matching_tokens(held.select("token").distinct(), vocab.select("word").distinct()).hint("merge")
    return held.join(pairs, "token").select(*by, "id", "created_at", "word").distinct()


def _scored(df: DataFrame, candidates: DataFrame, bags: DataFrame, scope: list[str], by: list[str]) -> DataFrame:
    """``(…scope, id, created_at, score)``: each candidate's row meets its text
    once, and all words of its query are looked up there."""
    key = F.xxhash64(*by, "id").alias("_h")       # narrows only: a chance match is dropped by the join
    rows = df.select(*by, "id", "created_at", F.lower(search_text(df)).alias("_text"), key)
    rows = rows.join(candidates.select(key).distinct(), "_h", "left_semi").drop("_h")
    met = rows.join(candidates.join(bags, scope).hint("merge"), [*by, "id"])
    score = F.aggregate(F.split("_bag", " "), F.lit(0).cast("bigint"), lambda n, w: n + F.when(F.contains("_text", w), 1).otherwise(0))
    return met.select(*scope, "id", "created_at", score.alias("score")).where("score > 0")


def _longest(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """``(…by, id)`` of the ``n`` longest rows (of each owner): they hold many words."""
    rows = df.select(*by, "id", F.length(search_text(df)).alias("_n")).where("id is not null and _n is not null")
    if not by:
        return rows.orderBy(F.col("_n").desc(), "id").limit(n).select("id")
    w = Window.partitionBy(*by).orderBy(F.col("_n").desc(), "id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(*by, "id")


def _ranked(scored: DataFrame, scope: list[str], limit: int | None) -> DataFrame:
    w = Window.partitionBy(*scope).orderBy(F.col("score").desc(), F.col("created_at").desc(), F.col("id").asc())
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= limit) if limit is not None else ranked


def _first_rows(df: DataFrame, qw: DataFrame, scope: list[str], by: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each query, by the bound above; written, as
    the tables it needs are gone when it returns."""
    few = 4 * limit
    held = df.select(*by, "id", F.explode(F.array_distinct(words(search_text(df)))).alias("token"))
    held = materialize(held, "keyword-held")
    # Stands for a token of an owner: two tokens of one key give candidates too many, never too few.
    key = F.xxhash64(*by, "token").alias("key")
    tokens = materialize(held.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df")), "keyword-tokens")
    vocab = materialize(qw.select("word").distinct(), "keyword-words")
    if by:
        pairs = materialize(matching_tokens(tokens.select("token").distinct(), vocab), "keyword-pairs")
        asked = tokens.join(pairs.hint("merge"), "token").join(qw.select(*by, "word").distinct().hint("merge"), [*by, "word"])
    else:
        pairs, asked = None, matching_tokens(tokens, vocab)
    asked = materialize(asked.select(*by, "word", "token", "df"), "keyword-asked")
    # What a word's tokens cost orders the words; the bound holds whatever the order.
    known = qw.join(asked.groupBy(*by, "word").agg(F.sum("df").alias("cost")), [*by, "word"])
    order = Window.partitionBy(*scope).orderBy("cost", "word")
    total = F.sum("repeats").over(Window.partitionBy(*scope))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = materialize(known.select(
        *scope, "word", "repeats", (total - F.sum("repeats").over(so_far)).alias("rest"),
        F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "keyword-known")
    # A query's words in one text, each as often as it is repeated.
    bags = known.groupBy(*scope).agg(F.array_join(F.flatten(F.collect_list(
        F.array_repeat("word", F.col("repeats").cast("int")))), " ").alias("_bag"))

    def holders(chosen):
        """``chosen`` words of queries with the rows that hold them, and the table of keys that this reads."""
        wanted = chosen.select(*by, "word").distinct()
        met = materialize((wanted.hint("merge") if by else wanted).join(asked, [*by, "word"]).select(*by, "word", key), "keyword-met")
        rows = held.select(*by, "id", key).join(met.select("key").distinct(), "key", "left_semi")
        rows = rows.join(met.hint("merge"), [*by, "key"]).select(*by, "id", "word").distinct()
        return chosen.join(rows.hint("merge"), [*by, "word"]), met

    long = _longest(df, by, limit)
    if by:
        long = bags.select(*scope).join(long, by)
    else:
        ids = long.agg(F.collect_list("id").alias("ids")).select("ids").scalar()
        long = bags.select(*scope, ids.alias("ids")).select(*scope, F.explode("ids").alias("id"))
    rare, met = holders(known.where(F.col("before") < few))
    seeds = materialize(rare.select(*scope, "id").unionByName(long.select(*scope, "id")).distinct(), "keyword-seeds")
    # Equal rows are one row, here too: else the bound would count them twice.
    first = materialize(_scored(df, seeds, bags, scope, by).distinct(), "keyword-first")
    drop_materialized(met)
    least = _ranked(first, scope, limit).where(F.col("rank") == limit).select(*scope, F.col("score").alias("least"))
    # ``rest``: what a row can score that holds none of the words up to here.
    bound = known.join(least, scope, "left").withColumn("least", F.coalesce("least", F.lit(0)))
    bound = materialize(bound.where((F.col("rest") + F.col("repeats") >= F.col("least") - MORE) & (F.col("before") >= few)), "keyword-bound")
    # A row that is not scored yet holds none of the words before these.
    last = bound.groupBy(*scope).agg(F.min("rest").alias("last"))
    held_words, met = holders(bound)
    got = held_words.groupBy(*scope, "id").agg(F.sum("repeats").alias("got"), F.max("least").alias("least"))
    rest = got.join(last, scope).where(F.col("got") + F.col("last") >= F.col("least")).select(*scope, "id")
    rest = materialize(rest.join(seeds.hint("merge"), [*scope, "id"], "left_anti"), "keyword-rest")
    further = _scored(df, rest, bags, scope, by)
    out = materialize(_ranked(first.unionByName(further).distinct(), scope, limit), "keyword-hits")
    drop_materialized(held, tokens, vocab, asked, known, seeds, first, bound, met, rest, *([pairs] if by else []))
    return out


def keyword_search(df: DataFrame, queries: DataFrame, limit: int | None = 5, query_col: str = "query",
                   key_cols=("query_id",), by=()) -> DataFrame:
    """Q7 for a table of queries: ``(…keys, …by, id, created_at, score, rank)``.

    ``limit=None`` keeps every row with score > 0.  With ``by``, queries carry
    the owner columns and see their owner's rows.
    """
    by = list(by)
    scope = [*key_cols, *[c for c in by if c not in key_cols]]
    qw = query_words(queries, query_col, scope)
    if limit is not None:
        return _first_rows(df, qw, scope, by, limit)
    hits = word_hits(df, qw, by=by)
    scored = (hits.join(qw, [*by, "word"]).groupBy(*scope, "id", "created_at")
              .agg(F.sum("repeats").cast("bigint").alias("score")))
    return _ranked(scored, scope, None)

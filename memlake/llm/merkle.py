"""Operator 12, Merkle dataset manifest by slot pivot.

A tree over ordered nodes: every ``FANOUT`` consecutive nodes of a level have
one parent, until one node is left.  A level is one aggregation by (scope,
position div fanout): conditional aggregates spread the children into one
column a slot.  Concatenating all slots and hashing gives the parent; leaving
out a child's own slot gives its siblings, those before and those behind it.

The rows of a language are the leaves of one tree, the roots of the languages
the leaves of another.  Positions come from a table dealt by range of (language,
id): the place within a partition plus the counts of the partitions before it,
so no task sees more than its range, however many rows a language has.  From
the top down, every parent row takes the path above it (one array of siblings
before and behind, level by level) and hands it on to its slots; only at the
leaves it becomes one row a document, where the proof is hashed and the root
folded again from the leaf.

Defined cases: null columns are ``-`` in a leaf; rows of null language are a
language of their own, before all others; rows of equal id (repeated rows, null
ids, which come first) are ordered by leaf, equal leaves in any order, which
does not change any digest of the tree; very long texts are hashed once where they
are read and never shuffled; further columns are ignored; an empty table gives
an empty table, without a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, staged

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(*parts):
    return F.sha2(F.concat(*parts), 256)


def _part(value):
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns) -> F.Column:
    """H of the given columns, each ``-`` or byte count, colon and value."""
    return _digest(*[_part(c) for c in columns])


def lower_case_tampering(docs: DataFrame, of_each: int = 3) -> F.Column:
    """The text as a tampered row would hold it, null where a row is left alone."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % of_each == 0
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(chosen, folded)


def positions(nodes: DataFrame, scope: str, order: list[str], name: str) -> DataFrame:
    """``nodes`` (a written table) with ``pos`` from 0 within ``scope`` by
    ``order``, and ``n``, the scope's number of nodes.  A written table."""
    # Equal keys may be dealt to several partitions: the last key tells them apart.
    nodes = nodes.withColumn("_tie", F.monotonically_increasing_id())
    keys = [scope, *order, "_tie"]
    dealt = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = staged(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_in", F.shiftright("_at", 33)), f"{name}-dealt")
    runs = dealt.groupBy(scope, "_in").agg(F.count(F.lit(1)).alias("_count"), F.min("_at").alias("_first"))
    before = Window.partitionBy(scope).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
                  .withColumn("n", F.sum("_count").over(Window.partitionBy(scope))), f"{name}-runs")
    placed = dealt.join(runs.drop("_count"), [scope, "_in"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    out = staged(placed.drop("_in", "_at", "_first", "_before"), f"{name}-placed")
    dropped(dealt, runs)
    return out


def _pivot(nodes: DataFrame, scope: str, carried: list[str], fanout: int) -> DataFrame:
    """One row a parent: (scope, pos, n, s0.., one column a slot for each of
    ``carried``).  ``n`` is the number of nodes of the parents' level."""
    slot = F.col("pos") % fanout
    spread = [F.max(F.when(slot == j, F.struct(*[F.col(c) for c in ("digest", *carried)]))).alias(f"s{j}") for j in range(fanout)]
    up = nodes.groupBy(scope, F.expr(f"pos div {fanout}").alias("pos")).agg(
        F.max(F.expr(f"(n + {fanout - 1}) div {fanout}")).alias("n"), *spread)
    return up.withColumn("digest", _digest(*[F.coalesce(F.col(f"s{j}")["digest"], F.lit("")) for j in range(fanout)]))


def _slots(parents: DataFrame, scope: str, carried: list[str], above: list[str], fanout: int) -> DataFrame:
    """The children of pivoted rows with a ``path`` of their own: the siblings
    before and behind on this level, then the parent's path."""
    def joined(js):
        return F.concat(F.lit(""), *[F.coalesce(F.col(f"s{j}")["digest"], F.lit("")) for j in js])
    child = F.array(*[F.when(F.col(f"s{j}").isNotNull(), F.struct(
        F.lit(j).alias("slot"), F.col(f"s{j}").alias("node"),
        F.struct(joined(range(j)).alias("before"), joined(range(j + 1, fanout)).alias("behind")).alias("here"))) for j in range(fanout)])
    rows = parents.select(scope, "pos", "path", *above, F.explode(F.filter(child, lambda c: c.isNotNull())).alias("c"))
    return rows.select(scope, (F.col("pos") * fanout + F.col("c.slot")).alias("pos"), "c.node.digest", *[f"c.node.{c}" for c in carried],
                       F.concat(F.array("c.here"), F.col("path")).alias("path"), *above)


_NO_PATH = "cast(array() as array<struct<before:string,behind:string>>)"


class Tree:
    """The trees of all scopes of ``placed``: digest, pos, n and ``carried``
    columns of each node.  Levels are written tables; ``drop`` deletes them."""

    def __init__(self, placed: DataFrame, scope: str, carried: list[str], name: str, fanout: int = FANOUT):
        self.scope, self.carried, self.fanout, self.name = scope, carried, fanout, name
        self.placed, self.levels = placed, []
        tallest = placed.agg(F.max("n")).first()[0] or 0
        below, kept = placed, carried
        while tallest > 1:
            level = staged(_pivot(below.where("n > 1"), scope, kept, fanout), f"{name}-level")
            self.levels.append(level)
            below, kept, tallest = level.select(scope, "pos", "n", "digest"), [], -(-tallest // fanout)

    def roots(self) -> DataFrame:
        """(scope, digest): the one node left of each scope."""
        ends = [self.placed, *self.levels]
        out = [t.where("n = 1").select(self.scope, "digest") for t in ends]
        for t in out[1:]:
            out[0] = out[0].unionByName(t)
        return out[0]

    def paths(self, tops: DataFrame) -> DataFrame:
        """One row a leaf: (scope, pos, digest, …carried, path, …), the path
        continued by that of ``tops``, (scope, path, …) of every scope."""
        scope, above = self.scope, [c for c in tops.columns if c not in (self.scope, "path")]
        top = tops.select(scope, "path", *above)
        handed = None
        for i in reversed(range(len(self.levels))):
            level, kept = self.levels[i], self.carried if i == 0 else []
            rows = level.where("n = 1").join(top, scope)
            if handed is not None:
                rows = rows.unionByName(level.where("n > 1").join(handed.select(scope, "pos", "path", *above), [scope, "pos"]))
            handed = _slots(rows, scope, kept, above, self.fanout)
        single = self.placed.where("n = 1").join(top, scope).select(scope, "pos", "digest", *self.carried, "path", *above)
        return single if handed is None else single.unionByName(handed)

    def drop(self) -> None:
        dropped(self.placed, *self.levels)


def folded(leaf, path) -> F.Column:
    """The root that a leaf digest and its path give."""
    return F.aggregate(path, leaf, lambda h, s: _digest(s["before"], h, s["behind"]))


def proof_digest(path) -> F.Column:
    """H of all siblings, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["behind"])), ""), 256)


def manifest(docs: DataFrame, tampered=None, columns=COLUMNS, id_col: str = "doc_id", scope_col: str = "lang",
             text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, path
    (siblings before and behind, level by level), folded_root, verified.
    ``tampered`` gives the text that a check would read (null: the same)."""
    tampered = F.lit(None).cast("string") if tampered is None else tampered
    fields = [F.col(c) for c in columns]
    changed = [tampered if c == text_col else F.col(c) for c in columns]
    leaves = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(scope_col).cast("string")), F.lit("")).alias("scope"),
        leaf_digest(fields).alias("digest"),
        F.when(tampered.isNotNull() & (tampered != F.col(text_col)), leaf_digest(changed)).alias("read"))
    leaves = staged(leaves, "op12-leaves")
    placed = positions(leaves, "scope", ["doc_id", "digest"], "op12")
    dropped(leaves)
    within = Tree(placed, "scope", ["doc_id", "read"], "op12", fanout)
    roots = staged(within.roots().select(F.lit("").alias("all"), "digest", F.col("scope").alias("part")), "op12-roots")
    over = Tree(positions(roots, "all", ["part"], "op12-all"), "all", ["part"], "op12-all", fanout)
    whole = over.roots().select("all", F.expr(_NO_PATH).alias("path"), F.col("digest").alias("root"))
    tops = staged(over.paths(whole).select(F.col("part").alias("scope"), "path", F.col("digest").alias("subroot"), "root"), "op12-tops")
    dropped(roots)
    over.drop()
    out = within.paths(tops).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "path",
        folded(F.coalesce("read", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Exclusion rules (F8-F16).

Rules come in two shapes:

* a ``Rules`` value (one scope, the reference's semantics): the lists become
  literal arrays inside one codegen'd filter;
* a rules DataFrame with owner columns (``by=[...]``): joined to the records on
  the owner key, then the same predicate reads the joined columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_KEYS = ("exclude_sensitive", "exclude_tags", "exclude_categories", "exclude_keywords")

RULES_SCHEMA = T.StructType([
    T.StructField("exclude_sensitive", T.BooleanType(), True),
    T.StructField("exclude_tags", T.ArrayType(T.StringType()), True),
    T.StructField("exclude_categories", T.ArrayType(T.StringType()), True),
    T.StructField("exclude_keywords", T.ArrayType(T.StringType()), True),
])


@dataclass(frozen=True)
class Rules:
    exclude_sensitive: bool = True
    exclude_tags: tuple[str, ...] = field(default_factory=tuple)
    exclude_categories: tuple[str, ...] = field(default_factory=tuple)
    exclude_keywords: tuple[str, ...] = field(default_factory=tuple)

    def set(self, key: str, value) -> "Rules":
        """Return a copy with one rule changed; unknown keys are an error."""
        if key not in RULE_KEYS:
            raise ValueError(f"no rule is called {key!r}; rules are {', '.join(RULE_KEYS)}")
        if key != "exclude_sensitive":
            value = tuple(value)
        return replace(self, **{key: value})

    def to_dict(self) -> dict:
        return {"exclude_sensitive": self.exclude_sensitive,
                "exclude_tags": list(self.exclude_tags),
                "exclude_categories": list(self.exclude_categories),
                "exclude_keywords": list(self.exclude_keywords)}

    @classmethod
    def from_json(cls, text: str | None) -> "Rules":
        """Rules from a JSON document; missing keys take defaults, an
        unreadable document gives all defaults (sensitive stays hidden)."""
        try:
            doc = json.loads(text) if text else {}
        except (ValueError, TypeError):
            doc = {}
        if not isinstance(doc, dict):
            doc = {}
        out = cls()
        for k in RULE_KEYS:
            if k in doc:
                out = replace(out, **{k: doc[k] if k == "exclude_sensitive" else tuple(doc[k])})
        return out


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def hidden(rules: Rules | None = None) -> Column:
    """Boolean: the row is hidden by the rules (OR of F8-F11)."""
    rules = rules or Rules()
    preds = []
    if rules.exclude_sensitive:
        preds.append(F.col("sensitive"))
    if rules.exclude_categories:
        preds.append(F.col("category").isin(list(rules.exclude_categories)))
    if rules.exclude_tags:
        preds.append(F.coalesce(F.arrays_overlap(F.col("tags"), _lit_array(rules.exclude_tags)),
                                F.lit(False)))
    if rules.exclude_keywords:
        lc = F.lower(F.col("content"))
        for kw in rules.exclude_keywords:
            preds.append(lc.contains(F.lit(kw.lower())))
    if not preds:
        return F.lit(False)
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return F.coalesce(out, F.lit(False))


def hidden_by_columns() -> Column:
    """The same predicate, reading rule columns joined onto each row."""
    sens = F.coalesce(F.col("exclude_sensitive"), F.lit(True)) & F.col("sensitive")
    cat = F.coalesce(F.array_contains(F.col("exclude_categories"), F.col("category")), F.lit(False))
    tag = F.coalesce(F.arrays_overlap(F.col("tags"), F.col("exclude_tags")), F.lit(False))
    kw = F.coalesce(
        F.exists(F.col("exclude_keywords"),
                 lambda k: F.lower(F.col("content")).contains(F.lower(k))),
        F.lit(False))
    return F.coalesce(sens | cat | tag | kw, F.lit(False))


def exclude(df: DataFrame, rules: Rules | DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows not hidden by the rules (F12); order and columns are preserved.

    With a rules DataFrame and ``by`` owner columns, each row is judged by its
    owner's rules; owners without a rules row get the defaults.
    """
    if rules is None or isinstance(rules, Rules):
        return df.filter(~hidden(rules))
    by = list(by or [])
    if not by:
        raise ValueError("a rules DataFrame needs owner columns in by=[...]; "
                         "use a Rules value for a single scope")
    rule_cols = list(RULE_KEYS)
    # One rules row per owner: AQE broadcasts it where its bytes allow, else it
    # splits the partition of an owner who holds a third of the records.
    joined = df.join(rules.select(*by, *rule_cols), on=by, how="left")
    return joined.filter(~hidden_by_columns()).drop(*rule_cols)


def exclude_tags(df: DataFrame, tags) -> DataFrame:
    """Extra per-call tag exclusion (F16)."""
    tags = [t for t in tags if t is not None]
    if not tags:
        return df
    return df.filter(~F.coalesce(F.arrays_overlap(F.col("tags"), _lit_array(tags)), F.lit(False)))


def rules_table(docs: DataFrame, text_col: str = "value") -> DataFrame:
    """Rules rows from JSON documents (F14): missing keys -> defaults, an
    unreadable document -> all defaults; other columns (owners) are kept."""
    parsed = F.from_json(F.col(text_col), RULES_SCHEMA, {"mode": "PERMISSIVE"})
    empty = F.array().cast("array<string>")
    others = [c for c in docs.columns if c != text_col]
    return docs.select(
        *others,
        F.coalesce(parsed["exclude_sensitive"], F.lit(True)).alias("exclude_sensitive"),
        F.coalesce(parsed["exclude_tags"], empty).alias("exclude_tags"),
        F.coalesce(parsed["exclude_categories"], empty).alias("exclude_categories"),
        F.coalesce(parsed["exclude_keywords"], empty).alias("exclude_keywords"),
    )


def unknown_rule_keys(docs: DataFrame, text_col: str = "value") -> DataFrame:
    """Rows whose JSON document names a key that is not a rule (F14 errors)."""
    keys = F.json_object_keys(F.col(text_col))
    bad = F.filter(keys, lambda k: ~k.isin(list(RULE_KEYS)))
    return docs.withColumn("unknown_keys", bad).filter(F.size("unknown_keys") > 0)


def rules_frame(spark, rules: Rules, owner: dict | None = None) -> DataFrame:
    """A one-row rules DataFrame from a ``Rules`` value."""
    owner = owner or {}
    row = {**owner, **rules.to_dict()}
    schema = T.StructType([T.StructField(k, T.StringType()) for k in owner] + list(RULES_SCHEMA.fields))
    return spark.createDataFrame([row], schema)


def active_rules(rules: DataFrame, only_active: bool = False) -> DataFrame:
    """Rules as ``(…owners, rule, value)`` rows, value as JSON text.

    ``only_active`` keeps true flags and non-empty lists only.
    """
    owners = [c for c in rules.columns if c not in RULE_KEYS]
    entries = F.array(
        F.struct(F.lit("exclude_sensitive").alias("rule"),
                 F.when(F.col("exclude_sensitive"), F.lit("true")).otherwise(F.lit("false")).alias("value"),
                 F.col("exclude_sensitive").cast("int").alias("n")),
        *[F.struct(F.lit(k).alias("rule"), F.to_json(F.col(k)).alias("value"),
                   F.size(F.col(k)).alias("n")) for k in RULE_KEYS[1:]],
    )
    out = rules.select(*owners, F.inline(entries))
    if only_active:
        out = out.filter(F.col("n") > 0)
    return out.drop("n")


def parse_rule_settings(settings: DataFrame) -> DataFrame:
    """``(…owners, key, value)`` text settings to typed rule values.

    ``exclude_sensitive``: true / 1 / yes (any case) is true, else false.
    List rules: comma-separated, trimmed, blanks dropped.  Unknown keys are
    returned with ``error`` set instead of a value.
    """
    key, raw = F.col("key"), F.col("value")
    items = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return settings.select(
        *[c for c in settings.columns if c not in ("key", "value")],
        key.alias("rule"),
        F.when(key == "exclude_sensitive", F.lower(raw).isin("true", "1", "yes")).alias("flag"),
        F.when(key.isin(*RULE_KEYS[1:]), items).alias("items"),
        F.when(~key.isin(*RULE_KEYS), F.concat(F.lit("no rule is called "), key)).alias("error"),
    )


def apply_rule_settings(rules: DataFrame, parsed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Set per-owner rule values from parsed settings (F15 applied to F14).

    Owners are matched with an equi-join on ``by``; for a single scope use
    ``Rules.set`` instead.  Of several settings of one key the one with the
    highest ``seq`` (a column that ``parsed`` must have) wins.
    """
    by = list(by or [])
    if not by:
        raise ValueError("apply_rule_settings needs owner columns in by=[...]")
    if "seq" not in parsed.columns:
        raise ValueError("apply_rule_settings needs a seq column that orders the settings")
    good = parsed.filter(F.col("error").isNull())
    piv = good.groupBy(*by).agg(
        F.max(F.when(F.col("rule") == "exclude_sensitive", F.struct("seq", F.col("flag").cast("int").alias("v"))))["v"].alias("s"),
        *[F.max(F.when(F.col("rule") == k, F.struct("seq", F.col("items").alias("v"))))["v"].alias(k + "_new")
          for k in RULE_KEYS[1:]])
    joined = rules.join(piv, on=by, how="left")
    return joined.select(
        *by,
        F.coalesce(F.col("s").cast("boolean"), F.col("exclude_sensitive")).alias("exclude_sensitive"),
        *[F.coalesce(F.col(k + "_new"), F.col(k)).alias(k) for k in RULE_KEYS[1:]],
    )

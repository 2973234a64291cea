"""Masking of whole log rows, policies, leak reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MaskPolicy, MaskRule
from ..functions.pii import (
    category_order,
    contains_pii,
    first_match,
    key_rule_for,
    mask_all_pii,
    mask_text,
    pattern_table,
)
from ..functions.regex import python_regex
from ..functions.text import text
from ..schemas import LOG_TYPES, MAX_LEVEL, MIN_LEVEL, ORIGINS

TOO_DEEP = "[MAX_DEPTH_EXCEEDED]"
CLIENT_TOO_DEEP = "[CIRCULAR_REFERENCE_OR_TOO_DEEP]"
SNIPPET_BYTES = 50


def _mask_fields(df: DataFrame, mask, keep, keys: Mapping[str, str] | None = None) -> DataFrame:
    """Rewrite every free-text field with ``mask``; ``keep(name)`` protects it."""
    have = set(df.columns)
    keys = keys or {}

    def value(name: Column, v: Column) -> Column:
        body = F.when(keep(name), v)
        for k, replacement in keys.items():
            body = body.when(name == k, F.lit(replacement))
        return body.otherwise(mask(v))

    out: dict[str, Column] = {"message": mask(F.col("message"))}
    if "actor_id" in have:
        out["actor_id"] = F.when(keep(F.lit("actorId")), F.col("actor_id")).otherwise(mask(F.col("actor_id")))
    if "tags" in have:
        out["tags"] = F.transform("tags", lambda t: t.withField("category", value(t["key"], t["category"])))
    if "input" in have:
        out["input"] = mask(F.col("input"))
    if "details" in have:
        out["details"] = F.transform_values("details", value)
    if "ai_context" in have:
        ai = F.col("ai_context")
        out["ai_context"] = F.when(ai.isNotNull(), ai.withField("reasoning_trace", mask(ai["reasoning_trace"])))
    if "agent_back_log" in have:
        out["agent_back_log"] = F.transform("agent_back_log", lambda e: e.withField("result", mask(e["result"])))
    return df.withColumns(out)


def mask_log(
    df: DataFrame,
    rules: Sequence[MaskRule],
    preserve: Sequence[str] = (),
    pattern_set: str | Mapping[str, str] = "server",
) -> DataFrame:
    """Mask every free-text field; message always, the others unless preserved."""
    keep = (lambda name: name.isin(*preserve)) if preserve else (lambda name: F.lit(False))
    return _mask_fields(df, lambda c: mask_text(c, rules, pattern_set), keep, key_rule_for(rules))


# --- policies -------------------------------------------------------------

def _applies(p: MaskPolicy, log_type: str, origin: str, level: int) -> bool:
    return (
        (not p.log_types or log_type in p.log_types)
        and (not p.origins or origin in p.origins)
        and (p.min_level <= 0 or level >= p.min_level)
        and (p.max_level <= 0 or level <= p.max_level)
    )


class PolicyVariants:
    """Policies resolved for every (type, origin, level) a normalised log can have.

    All matching policies contribute, so the outcome depends only on those three
    small columns.  Resolving the grid on the driver leaves a few distinct rule
    lists, and a row picks its list by number: the plan grows with the number of
    distinct outcomes, not with policies x rules x fields.
    """

    def __init__(self, policies: Sequence[MaskPolicy], default_rules: Sequence[MaskRule], preserve: Sequence[str]):
        self.outcomes: list[tuple[tuple[MaskRule, ...], tuple[str, ...]]] = []
        number: dict[str, int] = {}
        for t in LOG_TYPES:
            for o in ORIGINS:
                for lv in range(MIN_LEVEL, MAX_LEVEL + 1):
                    hits = [p for p in policies if _applies(p, t, o, lv)]
                    rules = tuple(r for p in hits for r in p.rules) if hits else tuple(default_rules)
                    kept = tuple(dict.fromkeys([*preserve, *(f for p in hits for f in p.preserve_extra)]))
                    if (rules, kept) not in self.outcomes:
                        self.outcomes.append((rules, kept))
                    number[f"{t}|{o}|{lv}"] = self.outcomes.index((rules, kept))
        self._lookup = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])

    def variant(self) -> Column:
        key = F.concat_ws("|", F.col("type"), F.col("origin"), F.col("level").cast("string"))
        return F.element_at(self._lookup, key)

    def choose(self, per_outcome: Sequence[Column], variant: Column) -> Column:
        if len(per_outcome) == 1:
            return per_outcome[0]
        expr = F.when(variant == 0, per_outcome[0])
        for i, c in enumerate(per_outcome[1:], start=1):
            expr = expr.when(variant == i, c)
        return expr

    def preserve(self, variant: Column) -> Column:
        lists = [F.array(*[F.lit(f) for f in kept]).cast("array<string>") for _, kept in self.outcomes]
        return self.choose(lists, variant)


def mask_with_policies(
    df: DataFrame,
    policies: Sequence[MaskPolicy],
    default_rules: Sequence[MaskRule],
    preserve: Sequence[str] = (),
    pattern_set: str | Mapping[str, str] = "server",
    keep_variant: bool = False,
) -> DataFrame:
    """Mask normalised rows by the policies that match them, else by the default."""
    variants = PolicyVariants(policies, default_rules, preserve)
    v, p = F.col("_variant"), F.col("_preserve")

    def mask(c: Column) -> Column:
        return variants.choose([mask_text(c, rules, pattern_set) for rules, _ in variants.outcomes], v)

    marked = df.withColumn("_variant", variants.variant()).withColumn("_preserve", variants.preserve(v))
    keys: dict[str, str] = {}
    for rules, _ in variants.outcomes:
        for k, r in key_rule_for(rules).items():
            keys.setdefault(k, r)
    if keys:
        out = _mask_policy_keys(marked, variants, mask, v, p)
    else:
        out = _mask_fields(marked, mask, lambda name: F.array_contains(p, name))
    return out if keep_variant else out.drop("_variant", "_preserve")


def _mask_policy_keys(marked: DataFrame, variants: PolicyVariants, mask, v: Column, p: Column) -> DataFrame:
    """The same when some outcomes carry KEY_MATCH rules: keys per outcome."""
    maps = []
    for rules, _ in variants.outcomes:
        pairs = [F.lit(x) for kv in key_rule_for(rules).items() for x in kv]
        maps.append(F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))
    marked = marked.withColumn("_keys", variants.choose(maps, v))
    out = _mask_fields(marked, mask, lambda name: F.array_contains(p, name))
    by_key = F.col("_keys")

    def override(name: Column, masked: Column) -> Column:
        hit = F.try_element_at(by_key, name)
        return F.when(~F.array_contains(p, name) & hit.isNotNull(), hit).otherwise(masked)

    cols = {}
    if "tags" in marked.columns:
        cols["tags"] = F.transform("tags", lambda t: t.withField(
            "category", override(t["key"], t["category"])))
    if "details" in marked.columns:
        cols["details"] = F.transform_values("details", override)
    return out.withColumns(cols).drop("_keys")


# --- leaks ----------------------------------------------------------------

def leak_fields(df: DataFrame) -> Column:
    """(field, value) of every text a leak check looks at."""
    have = set(df.columns)
    pair = "array<struct<field:string,value:string>>"
    none = F.array().cast(pair)

    def one(name: str, c: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), c.alias("value"))

    flat = [one("message", F.col("message"))]
    flat += [one(n, F.col(c)) for n, c in (("actorId", "actor_id"), ("input", "input")) if c in have]
    parts = [F.array(*flat).cast(pair)]
    if "tags" in have:
        parts.append(F.coalesce(F.transform("tags", lambda t: F.struct(
            F.concat(F.lit("tags["), t["key"], F.lit("]")).alias("field"),
            t["category"].alias("value"))), none))
    if "details" in have:
        parts.append(F.coalesce(F.transform(F.map_entries("details"), lambda e: F.struct(
            F.concat(F.lit("details["), e["key"], F.lit("]")).alias("field"),
            e["value"].alias("value"))), none))
    if "ai_context" in have:
        parts.append(F.array(one("aiContext.reasoningTrace", F.col("ai_context.reasoning_trace"))).cast(pair))
    if "agent_back_log" in have:
        parts.append(F.coalesce(F.transform("agent_back_log", lambda e, i: F.struct(
            F.concat(F.lit("agentBackLog["), i, F.lit("].result")).alias("field"),
            e["result"].alias("value"))), none))
    return F.filter(F.concat(*parts), lambda f: text(f["value"]) != "")


def text_leaks(
    df: DataFrame, column: str, categories: Sequence[str] | None = None,
    pattern_set: str | Mapping[str, str] = "server",
) -> DataFrame:
    """One row per category found in a text column: ``category`` and ``snippet``."""
    table = pattern_table(pattern_set)
    hits = [
        F.struct(F.lit(name).alias("category"), first_match(F.col(column), name, table).alias("snippet"))
        for name in category_order(table, categories)
    ]
    found = F.explode(F.filter(F.array(*hits), lambda h: h["snippet"] != ""))
    out = df.withColumn("_leak", found)
    snip = F.col("_leak.snippet")
    cut = F.concat(F.make_valid_utf8(F.substring(snip.cast("binary"), 1, SNIPPET_BYTES).cast("string")), F.lit("..."))
    return out.withColumns({
        "category": F.col("_leak.category"),
        "snippet": F.when(F.octet_length(snip) > SNIPPET_BYTES, cut).otherwise(snip),
    }).drop("_leak")


def pii_leaks(
    df: DataFrame, keep: Sequence[str] = ("trace_id",), categories: Sequence[str] | None = None,
    pattern_set: str | Mapping[str, str] = "server",
) -> DataFrame:
    """Per field and category the first match: ``field_name``, ``category``, ``snippet``."""
    fields = df.select(*keep, F.inline(leak_fields(df)).alias("field_name", "_value"))
    return text_leaks(fields, "_value", categories, pattern_set).drop("_value")


def remask_leaks(
    df: DataFrame, preserve: Sequence[str] | Column = (), pattern_set: str | Mapping[str, str] = "server",
) -> DataFrame:
    """Mask everything in message, actor id and input where a leak is left.

    Masking a text without a leak changes nothing, so no separate test is needed.
    """
    if isinstance(preserve, Column):
        keep = lambda name: F.array_contains(preserve, name)
    else:
        keep = lambda name: F.lit(name in preserve)
    cols = {}
    for name, c in (("message", "message"), ("actorId", "actor_id"), ("input", "input")):
        if c in df.columns:
            cols[c] = F.when(keep(name), F.col(c)).otherwise(mask_all_pii(F.col(c), pattern_set))
    return df.withColumns(cols)


# --- nested values --------------------------------------------------------

def mask_value(
    c: Column, dtype: T.DataType, rules: Sequence[MaskRule], preserve: Sequence[str] = (),
    max_depth: int = 32, depth: int = 0, pattern_set: str | Mapping[str, str] = "server",
) -> Column:
    """Mask the strings inside a typed nested column, following its schema."""
    if isinstance(dtype, T.StringType):
        return mask_text(c, rules, pattern_set) if depth < max_depth else F.when(c.isNotNull(), F.lit(TOO_DEEP))
    keys = key_rule_for(rules)

    def child(v: Column, dt: T.DataType) -> Column:
        return mask_value(v, dt, rules, preserve, max_depth, depth + 1, pattern_set)

    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            if f.name in preserve:
                continue
            if f.name in keys and isinstance(f.dataType, T.StringType):
                c = F.when(c.isNotNull(), c.withField(f.name, F.lit(keys[f.name])))
            elif _has_text(f.dataType):
                c = F.when(c.isNotNull(), c.withField(f.name, child(c[f.name], f.dataType)))
        return c
    if isinstance(dtype, T.ArrayType) and _has_text(dtype.elementType):
        return F.transform(c, lambda v: child(v, dtype.elementType))
    if isinstance(dtype, T.MapType) and _has_text(dtype.valueType):
        def entry(k: Column, v: Column) -> Column:
            body = F.when(k.isin(*preserve), v) if preserve else None
            if isinstance(dtype.valueType, T.StringType):
                for name, repl in keys.items():
                    body = (body.when if body is not None else F.when)(k == name, F.lit(repl))
            masked = child(v, dtype.valueType)
            return masked if body is None else body.otherwise(masked)
        return F.transform_values(c, entry)
    return c


def _has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.StructType):
        return any(_has_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_text(dtype.elementType)
    return isinstance(dtype, T.MapType) and _has_text(dtype.valueType)


def mask_nested(
    df: DataFrame, columns: Sequence[str], rules: Sequence[MaskRule], preserve: Sequence[str] = (),
    max_depth: int = 32, pattern_set: str | Mapping[str, str] = "server",
) -> DataFrame:
    return df.withColumns({
        c: mask_value(F.col(c), df.schema[c].dataType, rules, preserve, max_depth, 0, pattern_set) for c in columns
    })


def json_leaves_masker(
    categories: Sequence[str], preserve: Sequence[str] = (), keys: Mapping[str, str] | None = None,
    max_depth: int = 32, pattern_set: str | Mapping[str, str] = "server", client: bool = False,
    max_array: int = 50,
):
    """A Pandas UDF that masks the strings inside JSON of unknown shape."""
    table = pattern_table(pattern_set)
    chain = [(table[c], f"[MASKED_{c}]") for c in categories if c in table]
    kept, key_map = frozenset(preserve), dict(keys or {})
    stop = CLIENT_TOO_DEEP if client else TOO_DEEP

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        compiled = [(python_regex(p), r) for p, r in chain]

        def mask(v, depth):
            # The client variant limits containers only, the server every value.
            if depth >= max_depth and (not client or isinstance(v, (dict, list))):
                return stop
            if isinstance(v, str):
                for p, r in compiled:
                    v = p.sub(r, v)
                return v
            if isinstance(v, dict):
                return {
                    k: x if k in kept or (client and x is None)
                    else key_map[k] if k in key_map
                    else mask(x, depth + 1)
                    for k, x in v.items()
                }
            if isinstance(v, list):
                items = v[:max_array] if client else v
                return [mask(x, depth + 1) for x in items]
            return v

        def one(s):
            if s is None:
                return None
            try:
                return json.dumps(mask(json.loads(s), 0), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return mask(s, 0)

        return values.map(one)

    return run


__all__ = [
    "PolicyVariants", "contains_pii", "json_leaves_masker", "leak_fields", "mask_log", "mask_nested",
    "mask_with_policies", "pii_leaks", "remask_leaks", "text_leaks",
]

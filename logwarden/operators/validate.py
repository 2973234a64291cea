"""Strict input rules that report instead of repairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_problem, trim_text
from ..schemas import (
    LOG_TYPES,
    MAX_LEVEL,
    MAX_RESOURCE_IDS,
    MAX_TAG_KEY_BYTES,
    MAX_TAG_VALUE_BYTES,
    MAX_TAGS,
    MAX_TEXT_BYTES,
    MIN_LEVEL,
    ORIGINS,
)


def _violation(cond: Column, field: Column | str, msg: Column | str) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.when(cond, F.struct(as_col(field).alias("field"), as_col(msg).alias("message")))


def _utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def _too_long(c: Column, limit: int) -> Column:
    # The exact count is needed only near the limit.
    return F.when(F.octet_length(c) <= limit, F.lit(False)).otherwise(_utf16_length(c) > limit)


def strict_violations(df: DataFrame) -> Column:
    """Array of all violations of a row in rule order; absent fields pass."""
    have = set(df.columns)
    checks: list[Column] = []
    if "message" in have:
        m = F.col("message")
        checks += [
            _violation(trim_text(m) == "", "message", "cannot be empty"),
            _violation(_too_long(m, MAX_TEXT_BYTES), "message", f"exceeds max length {MAX_TEXT_BYTES}"),
            _violation(F.contains(m, F.lit("\x00")), "message", "contains null bytes"),
        ]
    if "type" in have:
        t = F.col("type")
        checks.append(_violation(~t.isin(*LOG_TYPES), "type", F.concat(F.lit("invalid log type: "), t)))
    if "level" in have:
        checks.append(_violation(~F.col("level").between(MIN_LEVEL, MAX_LEVEL), "level", "must be integer 1-6"))
    if "origin" in have:
        o = F.col("origin")
        checks.append(_violation(~o.isin(*ORIGINS), "origin", F.concat(F.lit("invalid origin: "), o)))
    per_tag = None
    if "tags" in have:
        checks.append(_violation(F.size("tags") > MAX_TAGS, "tags", f"exceeds max count {MAX_TAGS}"))
        per_tag = F.flatten(F.transform(F.col("tags"), lambda t, i: F.array(
            _violation(t["key"].isNull() | _too_long(t["key"], MAX_TAG_KEY_BYTES),
                       F.concat(F.lit("tags["), i, F.lit("].key")), "invalid or too long"),
            _violation(t["category"].isNull() | _too_long(t["category"], MAX_TAG_VALUE_BYTES),
                       F.concat(F.lit("tags["), i, F.lit("].category")), "invalid or too long"),
        )))
    late: list[Column] = []
    if "resource_ids" in have:
        late.append(_violation(F.size("resource_ids") > MAX_RESOURCE_IDS, "resourceIds",
                               f"exceeds max count {MAX_RESOURCE_IDS}"))
    if "details_text" in have:
        late.append(_violation(_too_long(F.col("details_text"), MAX_TEXT_BYTES), "details",
                               f"exceeds max length {MAX_TEXT_BYTES}"))
    if "agent_back_log" in have:
        late.append(_violation(F.size("agent_back_log") > MAX_TAGS, "agentBackLog", f"exceeds max count {MAX_TAGS}"))
    if "ai_context" in have:
        late.append(_violation(F.col("ai_context.loop_depth") < 0, "aiContext.loopDepth",
                               "must be non-negative number"))
    shape = "array<struct<field:string,message:string>>"
    parts = [F.array(*checks).cast(shape)] if checks else []
    if per_tag is not None:
        parts.append(F.coalesce(per_tag, F.array().cast(shape)))
    if late:
        parts.append(F.array(*late).cast(shape))
    return F.filter(F.concat(*parts), lambda v: v.isNotNull())


def validate_strict(df: DataFrame, first_only: bool = True) -> DataFrame:
    """One row per violation with ``field`` and ``violation``; the first one wins."""
    found = strict_violations(df)
    found = F.slice(found, 1, 1) if first_only else found
    out = df.withColumn("_v", F.explode(found))
    return out.withColumns({"field": F.col("_v.field"), "violation": F.col("_v.message")}).drop("_v")


def tag_problems(tags: Column) -> Column:
    """Array of problems in tag order: count, then key and value of each tag."""
    count = F.when(F.size(tags) > MAX_TAGS, F.concat(
        F.lit("sanitize(tags): too many tags ("), F.size(tags), F.lit(f" > {MAX_TAGS})")))
    pieces = F.flatten(F.transform(tags, lambda t, i: F.array(
        _tag_problem(t["key"], i, "key", MAX_TAG_KEY_BYTES),
        _tag_problem(t["category"], i, "category", MAX_TAG_VALUE_BYTES),
    )))
    return F.filter(F.concat(F.array(count), F.coalesce(pieces, F.array().cast("array<string>"))),
                    lambda p: p.isNotNull())


def _tag_problem(c: Column, i: Column, part: str, limit: int) -> Column:
    body = text_problem(c, "@", limit)
    return F.replace(body, F.lit("(@)"), F.concat(F.lit("(tags["), i, F.lit(f"].{part})")))


def validate_tags(df: DataFrame, tags: str = "tags", first_only: bool = True) -> DataFrame:
    """One row per problem with its text in ``tag_problem``."""
    found = tag_problems(F.col(tags))
    found = F.slice(found, 1, 1) if first_only else found
    return df.withColumn("tag_problem", F.explode(found))

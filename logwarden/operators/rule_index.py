"""Configured rules by index: for rule sets in the thousands.

``detect.dynamic_rules`` compiles every rule into the plan, so plan and work grow with the rules.
Here the rules are a table that logs are joined to, and a log meets only rules that can fire:

* a rule whose pattern cannot match without some literal text is listed under three
  characters of that text, and a log looks up the trigrams of its message;
* any other rule is listed under its log types and the levels of its range, and a log
  looks up its type and level.

What meets is then tested in full, so the index only has to miss nothing.  The rules are broadcast
when they are few (counted), otherwise the joins shuffle.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DynamicRule
from ..functions.regex import spark_pattern
from ..plans.sizing import broadcast_if_small
from ..schemas import DETECTION, PRIORITIES
from .detect import build_payload, detectable

ANY = ""
#: Levels are 1 to 6; what lies outside counts as the end of it that is nearer.
LOWEST, HIGHEST = 0, 7

RULE = T.StructType([
    T.StructField("rule_pos", T.IntegerType()), T.StructField("rule_id", T.StringType()), T.StructField("event_name", T.StringType()),
    T.StructField("priority", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("builder", T.StringType()),
    T.StructField("types", T.ArrayType(T.StringType())), T.StructField("origins", T.ArrayType(T.StringType())),
    T.StructField("min_level", T.IntegerType()), T.StructField("max_level", T.IntegerType()), T.StructField("critical", T.BooleanType()),
    T.StructField("tag_keys", T.ArrayType(T.StringType())), T.StructField("pattern", T.StringType()), T.StructField("gram", T.StringType()),
])


def required_texts(pattern: str) -> list[str]:
    """Stretches of ASCII text, lower case, each of which every match contains; none if that cannot be said.

    Case folding may turn s and k into letters beyond ASCII, so they end a stretch where case
    does not matter.
    """
    from re import _constants as ops
    from re import _parser as parser

    if "[:" in pattern:  # named classes, which Python reads as something else
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    found: list[str] = []

    def walk(items: Iterable, any_case: bool) -> None:
        run = ""
        for op, value in items:
            char = chr(value).lower() if op is ops.LITERAL and value < 128 else ""
            if char and not (any_case and char in "sk"):
                run += char
                continue
            found.append(run)
            run = ""
            if op is ops.SUBPATTERN:
                _, added, removed, inner = value
                walk(inner, (any_case or bool(added & re.IGNORECASE)) and not removed & re.IGNORECASE)
        found.append(run)

    walk(tree, bool(tree.state.flags & re.IGNORECASE))
    return [f for f in found if len(f) >= 3]


def grams(text: str) -> set[str]:
    return {text[i:i + 3] for i in range(len(text) - 2)}


def indexed_rules(rules: Sequence[DynamicRule]) -> list[tuple]:
    """Rows of ``RULE``; ``gram`` is the trigram with the fewest rules among those a rule may be listed under."""
    options = [set().union(*map(grams, required_texts(r.message_pattern))) if r.message_pattern else set() for r in rules]
    load = Counter(g for o in options for g in o)
    rows = []
    for i, (r, o) in enumerate(zip(rules, options, strict=True)):
        gram = min(o, key=lambda g: (load[g], g)) if o else None
        rows.append((
            i, r.rule_id, r.event_name, r.priority.upper() if r.priority.upper() in PRIORITIES else "MEDIUM", float(r.score if r.score > 0 else 1.0),
            r.payload_builder.lower(), list(r.log_types), list(r.origins), int(r.min_level), int(r.max_level), r.require_critical,
            list(r.tag_keys), spark_pattern(r.message_pattern) if r.message_pattern else None, gram))
    return rows


def _payload() -> Column:
    """The payload of the rule a row is joined to; ``rule_id`` is the reference of a compliance rule."""
    intrusion, compliance = build_payload("security_intrusion"), build_payload("compliance_violation")
    other = build_payload("system_critical")
    named = F.struct(*[(F.col("_r.rule_id") if f.name == "rule_ref" else compliance[f.name]).alias(f.name) for f in DETECTION["payload"].dataType])
    return F.when(F.col("_r.builder") == "security_intrusion", intrusion).when(F.col("_r.builder") == "compliance_violation", named).otherwise(other)


def match_rules(df: DataFrame, rules: Sequence[DynamicRule]) -> DataFrame:
    """What ``detect.dynamic_rules`` gives: one row per log and rule that fires, in any order."""
    table = df.sparkSession.createDataFrame(indexed_rules(rules), RULE)
    rule = F.struct(*[f.name for f in RULE.fields]).alias("_r")
    types = F.when(F.size("types") > 0, F.array_distinct("types")).otherwise(F.array(F.lit(ANY)))
    def held(level: Column) -> Column:
        return F.least(F.greatest(F.coalesce(level, F.lit(LOWEST)), F.lit(LOWEST)), F.lit(HIGHEST))

    least, most = held(F.col("min_level")), F.when(F.col("max_level") > 0, held(F.col("max_level"))).otherwise(HIGHEST)
    levels = F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    by_cell = table.filter("gram is null").select(F.explode(types).alias("_type"), levels.alias("_levels"), rule).select(
        "_type", F.explode("_levels").alias("_level"), "_r")
    by_gram = table.filter("gram is not null").select(F.col("gram").alias("_gram"), rule)

    logs = detectable(df)
    message = F.lower("message")
    all_grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(message) - 2), lambda i: F.substring(message, i, F.lit(3))))
    told = logs.withColumn("_gram", F.explode(F.when(F.length(message) >= 3, all_grams))).join(broadcast_if_small(by_gram), "_gram").drop("_gram")
    placed = logs.withColumns({"_type": F.explode(F.array_distinct(F.array("type", F.lit(ANY)))), "_level": held(F.col("level"))}).join(
        broadcast_if_small(by_cell), ["_type", "_level"]).drop("_type", "_level")
    both = told.unionByName(placed)

    r = F.col("_r")
    fires = (
        ((F.size(r["types"]) == 0) | F.array_contains(r["types"], F.col("type")))
        & ((F.size(r["origins"]) == 0) | F.array_contains(r["origins"], F.col("origin")))
        & ((r["min_level"] <= 0) | (F.col("level") >= r["min_level"])) & ((r["max_level"] <= 0) | (F.col("level") <= r["max_level"]))
        & (r["critical"].isNull() | (F.col("is_critical") == r["critical"]))
        & F.forall(r["tag_keys"], lambda k: F.exists("tags", lambda t: t["key"] == k))
        & (r["pattern"].isNull() | F.rlike(F.col("message"), r["pattern"])))
    made = {"rule_pos": r["rule_pos"], "event_name": r["event_name"], "priority": r["priority"], "score": r["score"], "rule_id": r["rule_id"], "payload": _payload()}
    return both.filter(fires).withColumns({f.name: made[f.name].cast(f.dataType) for f in DETECTION.fields}).drop("_r")

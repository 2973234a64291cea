"""Detection rules as nullable struct columns.

A rule is a callable from a small column accessor to a nullable detection
struct.  All rules of a log are evaluated in one narrow stage and stay in one
array until scores are combined, so neither scoring nor the choice of the top
detection needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DynamicRule, sql_text
from ..functions.regex import spark_pattern
from ..functions.severity import priority_rank
from ..schemas import DETECTION, PAYLOAD, PRIORITIES

Rule = Callable[[Callable[[str], Column]], Column]

DEFAULT_THRESHOLD = 0.5
LOG_KEY = ("trace_id",)


def payload_sql(kind: str, **fields: str) -> str:
    """SQL of a payload struct; ``fields`` are SQL expressions over log columns."""
    parts = [f"'kind', {sql_text(kind)}"]
    for f in PAYLOAD.fields[1:]:
        parts.append(f"'{f.name}', CAST({fields.get(f.name, 'NULL')} AS {f.dataType.simpleString()})")
    return f"named_struct({', '.join(parts)})"


def payload(kind: str, **fields: str) -> Column:
    return F.expr(payload_sql(kind, **fields))


def detection_sql(event: str, priority: str, body: str, score: float = 0.0, rule_id: str = "") -> str:
    return (
        f"named_struct('rule_pos', 0, 'event_name', {sql_text(event)}, 'priority', {sql_text(priority)}, "
        f"'score', CAST({float(score)!r} AS DOUBLE), 'rule_id', {sql_text(rule_id)}, 'payload', {body})"
    )


def detection(event: str, priority: str, body: Column, score: float = 0.0, rule_id: str = "") -> Column:
    return F.struct(
        F.lit(0).alias("rule_pos"), F.lit(event).alias("event_name"), F.lit(priority).alias("priority"),
        F.lit(float(score)).alias("score"), F.lit(rule_id).alias("rule_id"), body.alias("payload"),
    )


def _restamped(d: Column, pos: Column, score: Column, rule_id: Column) -> Column:
    return F.when(d.isNotNull(), F.struct(
        pos.cast("int").alias("rule_pos"), d["event_name"].alias("event_name"), d["priority"].alias("priority"),
        score.alias("score"), rule_id.alias("rule_id"), d["payload"].alias("payload")))


def once(c: Column, keep: Callable[[Column], Column]) -> Column:
    """Generator of ``c`` if ``keep(c)``, else of no row.

    As a plain column the expression would be copied into every filter on it;
    a generator evaluates it once per row.
    """
    return F.explode(F.filter(F.array(c), keep))


IP_SQL = "coalesce(get(filter(tags, t -> t.key = 'ip'), 0).category, '0.0.0.0')"
RESOURCE_SQL = "coalesce(get(resource_ids, 0), 'unknown')"
ACTOR_SQL = "coalesce(nullif(actor_id, ''), 'system')"


def builder_sql(kind: str, rule_ref: str = "") -> str:
    """Payload by builder name; an unknown name builds the system payload."""
    kind = kind.lower()
    if kind == "security_intrusion":
        return payload_sql(kind, ip=IP_SQL, severity="level")
    if kind == "compliance_violation":
        return payload_sql(kind, rule_ref=sql_text(rule_ref), document_id=RESOURCE_SQL, user_id=ACTOR_SQL)
    return payload_sql("system_critical", component="boundary", error_details="message")


def build_payload(kind: str, rule_ref: str = "") -> Column:
    return F.expr(builder_sql(kind, rule_ref))


def sql_rule(condition: str, event: str, priority: str, body: str, score: float = 0.0, rule_id: str = "") -> Rule:
    """A rule written as SQL over the log columns."""
    text = f"CASE WHEN {condition} THEN {detection_sql(event, priority, body, score, rule_id)} END"
    return lambda c: F.expr(text)


# --- fixed rules ----------------------------------------------------------

critical_rule = sql_rule("is_critical", "SYSTEM_CRITICAL_FAILURE", "HIGH", builder_sql("system_critical"))
intrusion_rule = sql_rule("type = 'SECURITY' AND level >= 5", "SECURITY_INTRUSION_DETECTED", "HIGH",
                          builder_sql("security_intrusion"))
compliance_rule = sql_rule("type = 'COMPLIANCE' AND contains(lower(message), 'violation')", "COMPLIANCE_VIOLATION", "HIGH",
                           builder_sql("compliance_violation", "AUTO-DETECT-001"))
sla_rule = sql_rule("type = 'SLA' AND level >= 4", "SYSTEM_CRITICAL_FAILURE", "MEDIUM",
                    payload_sql("system_critical", component="boundary",
                                error_details="concat('SLA violation: ', message)"))

FIXED_RULES: tuple[Rule, ...] = (critical_rule, intrusion_rule, compliance_rule, sla_rule)


class ScoredRule:
    """A rule with a name and a fixed score."""

    def __init__(self, rule: Rule, rule_id: str, score: float):
        self.rule, self.rule_id, self.score = rule, rule_id, float(score)

    def __call__(self, c) -> Column:
        # The one-element array binds the inner struct, so that it is built once.
        bound = F.transform(F.array(self.rule(c)), lambda d: _restamped(
            d, d["rule_pos"], F.lit(self.score), F.lit(self.rule_id)))
        return F.get(bound, F.lit(0))


def wrap_rule(rule: Rule, rule_id: str, score: float) -> Rule:
    """Give a rule a name and a fixed score."""
    return ScoredRule(rule, rule_id, score)


# Names and scores of the built-in rules in an ensemble.
BUILTIN_SCORES = (
    ("builtin-critical", 1.0),
    ("builtin-security", 0.9),
    ("builtin-compliance", 0.85),
    ("builtin-sla", 0.7),
)


def ensemble_rules(dynamic: Sequence[DynamicRule] = ()) -> list[Rule]:
    fixed = [wrap_rule(r, rid, s) for r, (rid, s) in zip(FIXED_RULES, BUILTIN_SCORES)]
    return fixed + [compile_rule(r) for r in dynamic]


# --- configured rules -----------------------------------------------------

def _in(column: str, values: Sequence[str]) -> str:
    return f"{column} IN ({', '.join(map(sql_text, values))})"


def rule_condition(r: DynamicRule) -> str:
    """Cheap tests first; the message pattern last."""
    tests = ["true"]
    if r.log_types:
        tests.append(_in("type", r.log_types))
    if r.min_level > 0:
        tests.append(f"level >= {int(r.min_level)}")
    if r.max_level > 0:
        tests.append(f"level <= {int(r.max_level)}")
    if r.origins:
        tests.append(_in("origin", r.origins))
    if r.require_critical is not None:
        tests.append(f"is_critical = {str(r.require_critical).lower()}")
    tests += [f"exists(tags, t -> t.key = {sql_text(k)})" for k in r.tag_keys]
    if r.message_pattern:
        tests.append(f"rlike(message, {sql_text(spark_pattern(r.message_pattern))})")
    return " AND ".join(tests)


def compile_rule(r: DynamicRule) -> Rule:
    prio = r.priority.upper() if r.priority.upper() in PRIORITIES else "MEDIUM"
    score = r.score if r.score > 0 else 1.0
    return sql_rule(rule_condition(r), r.event_name, prio, builder_sql(r.payload_builder, r.rule_id), score, r.rule_id)


# --- evaluation -----------------------------------------------------------

def detectable(df: DataFrame) -> DataFrame:
    """Agent logs are skipped unless critical, so that agents do not trigger themselves."""
    return df.filter((F.col("origin") != "AI_AGENT") | F.col("is_critical"))


def detections_column(df: DataFrame, rules: Sequence[Rule]) -> Column:
    """Fired rules of a log in rule order, with their position; scores above 0 only."""
    named = [r if isinstance(r, ScoredRule) else None for r in rules]
    fired = [(n.rule if n else r)(lambda c: df[c]) for n, r in zip(named, rules)]
    scores = F.array(*[F.lit(n.score if n else None).cast("double") for n in named])
    ids = F.array(*[F.lit(n.rule_id if n else None).cast("string") for n in named])
    placed = F.transform(F.array(*fired), lambda d, i: _restamped(
        d, i, F.coalesce(F.get(scores, i), d["score"]), F.coalesce(F.get(ids, i), d["rule_id"])))
    return F.filter(placed, lambda d: d.isNotNull() & (d["score"] > 0))


def detect_first(df: DataFrame, rules: Sequence[Rule] = FIXED_RULES) -> DataFrame:
    """Rules in order, the first match wins; one row per log that matches."""
    logs = detectable(df)
    first = F.coalesce(*[r(lambda n: logs[n]) for r in rules])
    return flatten(logs.withColumn("detection", once(first, lambda d: d.isNotNull())))


def detect_ensemble(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Logs with at least one fired rule; fired rules in ``detections``."""
    logs = detectable(df)
    return logs.withColumn("detections", once(detections_column(logs, rules), lambda d: F.size(d) > 0))


def aggregate_score(detections: Column, method: str = "max") -> Column:
    scores = F.transform(detections, lambda d: d["score"])
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
    if method == "max":
        return F.array_max(scores)
    if method == "avg":
        return total / F.size(detections)
    if method == "weighted_sum":
        return F.least(total, F.lit(1.0))
    return F.get(scores, F.lit(0))


def apply_threshold(df: DataFrame, method: str = "max", min_score: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Keep all fired rules of a log or none, by the combined score."""
    scored = df.withColumn("aggregate_score", aggregate_score(F.col("detections"), method))
    return scored.filter(F.col("aggregate_score") >= F.lit(min_score or DEFAULT_THRESHOLD))


def top_detection(df: DataFrame) -> DataFrame:
    """Highest priority, then highest score, then rule order; one row per log."""
    ranked = F.transform("detections", lambda d: F.struct(
        priority_rank(d["priority"]).alias("p"), d["score"].alias("s"), (-d["rule_pos"]).alias("o"), d.alias("d")))
    return flatten(df.withColumn("detection", F.array_max(ranked)["d"]).drop("detections"))


def explode_detections(df: DataFrame) -> DataFrame:
    """One row per fired rule."""
    return flatten(df.withColumn("detection", F.explode("detections")).drop("detections"))


def flatten(df: DataFrame) -> DataFrame:
    d = F.col("detection")
    return df.withColumns({f.name: d[f.name] for f in DETECTION.fields}).drop("detection")


def threshold_rows(
    df: DataFrame, method: str = "max", min_score: float = DEFAULT_THRESHOLD, log_key: Sequence[str] = LOG_KEY,
) -> DataFrame:
    """The threshold for detections that are rows already, as after dedup.

    ``log_key`` identifies one log, so a group has at most one row per rule.
    """
    w = Window.partitionBy(*log_key)
    ordered = w.orderBy("rule_pos")
    score = {
        "max": F.max("score").over(w),
        "avg": F.avg("score").over(w),
        "weighted_sum": F.least(F.sum("score").over(w), F.lit(1.0)),
    }.get(method, F.first("score").over(ordered))
    scored = df.withColumn("aggregate_score", score)
    return scored.filter(F.col("aggregate_score") >= F.lit(min_score or DEFAULT_THRESHOLD))


def dynamic_rules(df: DataFrame, rules: Sequence[DynamicRule]) -> DataFrame:
    """Configured rules only; one row per match."""
    return explode_detections(detect_ensemble(df, [compile_rule(r) for r in rules]))

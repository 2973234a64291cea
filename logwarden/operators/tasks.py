"""Tasks from detections: rule lookup, dispatch decision, per-log result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import literal
from ..functions.crypto import content_id
from ..functions.severity import classify_severity, severity_rank
from ..schemas import SEVERITIES, TASK_RULE

# Actions that must not be dispatched without a handler.
MUST_HANDLE = ("KILL_SWITCH", "AUTOMATED_REMEDIATE")

_INDEXED = T.StructType([T.StructField("rank", T.IntegerType()), *TASK_RULE.fields])


def rule_index(rules: Sequence[dict]) -> Column:
    """event name -> its rules by (priority, position), as one folded literal."""
    by_event: dict[str, list[dict]] = {}
    for r in sorted(rules, key=lambda r: (r["priority"], r["rule_pos"])):
        rank = SEVERITIES.index(r["severity"]) if r["severity"] in SEVERITIES else 0
        by_event.setdefault(r["event_name"], []).append({**r, "rank": rank})
    return literal(by_event, T.MapType(T.StringType(), T.ArrayType(_INDEXED)))


def generate_tasks(
    detections: DataFrame, rules: Sequence[dict], now: Column | None = None, carry: Sequence[str] = (),
    id_cols: Sequence[str] = ("trace_id",),
) -> DataFrame:
    """One row per detection and matching rule, ``task_seq`` in rule priority order.

    Input rows are detections with the columns of their log.  Narrow: the rules
    of an event come out of a literal map, already ordered.
    """
    severity = classify_severity(F.col("event_name"), F.col("priority"), F.col("level"), F.col("is_critical"))
    src = detections.select(
        *carry, *[F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)],
        F.col("event_name"), severity.alias("severity"), F.col("rule_id").alias("detection_rule_id"),
        F.col("rule_pos").alias("detection_pos"), F.col("trace_id").alias("source_trace_id"),
        F.col("message").alias("source_message"), F.col("boundary").alias("source_boundary"),
        F.col("level").alias("source_level"), F.col("timestamp").alias("source_timestamp"),
        *([F.col("ai_context")] if "ai_context" in detections.columns and "ai_context" not in carry else []),
    )
    matching = F.filter(F.try_element_at(rule_index(rules), F.col("event_name")),
                        lambda r: r["rank"] <= F.col("_rank"))
    out = src.withColumn("_rank", severity_rank(F.col("severity"))).select(
        "*", F.posexplode(matching).alias("_seq", "_rule"))
    r = F.col("_rule")
    task_id = content_id(
        *[F.col(f"_id{i}").cast("string") for i in range(len(id_cols))],
        F.col("event_name"), r["rule_id"], F.col("detection_rule_id"), F.col("detection_pos").cast("string"),
    )
    return out.withColumns({
        "task_id": task_id,
        "task_seq": F.col("_seq") + 1,
        **{n: r[n] for n in ("rule_id", "action_type", "execution_level", "priority", "description",
                             "exec_params", "guardrails")},
        "created_at": F.current_timestamp() if now is None else now,
    }).drop("_rank", "_seq", "_rule", *[f"_id{i}" for i in range(len(id_cols))])


def rule_counts(rules: DataFrame) -> DataFrame:
    """Rules per event; the row with a null event is the total."""
    return rules.rollup("event_name").agg(F.count(F.lit(1)).alias("n_rules"))


def dispatch_status(df: DataFrame, column: str = "status") -> DataFrame:
    return df.withColumn(column, status_of(F.col("execution_level"), F.col("guardrails.require_human_approval")))


def status_of(level: Column, needs_approval: Column) -> Column:
    return (
        F.when(F.coalesce(needs_approval, F.lit(False)), "blocked_approval")
        .when(level.isin("AUTO", "SEMI_AUTO"), "dispatched")
        .when(level == "MANUAL", "blocked_approval")
        .otherwise("skipped")
    )


def unhandled(handled_actions: Sequence[str] = (), has_default: bool = False) -> Column:
    """Is the action one that must be handled, and nothing does?"""
    missing = [] if has_default else [a for a in MUST_HANDLE if a not in handled_actions]
    return F.coalesce(F.col("action_type").isin(*missing), F.lit(False)) if missing else F.lit(False)


def unhandled_error() -> Column:
    return F.concat(F.lit("CRITICAL: no handler registered for "), F.col("action_type"), F.lit(" (task="), F.col("task_id"), F.lit(")"))


def dispatch_outcome(df: DataFrame, handled_actions: Sequence[str] = (), has_default: bool = False) -> DataFrame:
    """A dispatched action that must be handled fails when nothing handles it."""
    failed = (F.col("status") == "dispatched") & unhandled(handled_actions, has_default)
    return df.withColumns({
        "error": F.when(failed, unhandled_error()).otherwise(""),
        "status": F.when(failed, "failed").otherwise(F.col("status")),
    })


def run_handlers(
    tasks: DataFrame, handlers: dict[str, Sequence[Callable[[DataFrame], None]]],
    default: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Hand the dispatched tasks of each action to its handlers, then report.

    A handler gets a DataFrame.  If it raises, its tasks become failed.
    """
    tasks = dispatch_outcome(tasks, list(handlers), default is not None)
    failures: dict[str, str] = {}
    for action, fns in handlers.items():
        part = tasks.filter((F.col("status") == "dispatched") & (F.col("action_type") == action))
        try:
            for fn in fns:
                fn(part)
        except Exception as e:  # noqa: BLE001 - a handler's failure is a result
            failures[action] = f"handler error: {e}"
    if default is not None:
        rest = tasks.filter((F.col("status") == "dispatched") & ~F.col("action_type").isin(*handlers, ""))
        try:
            default(rest)
        except Exception as e:  # noqa: BLE001
            failures[""] = str(e)
    for action, text in failures.items():
        mine = F.col("action_type") == action if action else ~F.col("action_type").isin(*handlers, "")
        hit = (F.col("status") == "dispatched") & mine
        tasks = tasks.withColumns({
            "error": F.when(hit, F.lit(text)).otherwise(F.col("error")),
            "status": F.when(hit, "failed").otherwise(F.col("status")),
        })
    return tasks


def ingestion_result(
    logs: DataFrame, tasks: DataFrame, threats: DataFrame, hash_chain: bool, masked: bool,
    key: Sequence[str] = ("trace_id",), warnings: Column | None = None,
) -> DataFrame:
    """One row per log with its task results and threat summaries.

    ``key`` identifies one log; a log has at most rules x rules results, so the
    collected lists are bounded by the rule tables.
    """
    t = tasks.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        "detection_pos", "task_seq", "task_id", "rule_id", "status"))).alias("tasks_generated"))
    r = threats.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        "rule_pos", "response_id", "event_name", "strategy", "blocked", "block_target",
        "analyzed", "risk_level", "notified"))).alias("threat_responses"))
    base = logs.select(
        *key, F.lit(hash_chain).alias("hash_chain_valid"), F.lit(masked).alias("masked"),
        (F.col("degraded") if "degraded" in logs.columns else F.lit(False)).alias("degraded"),
        (F.array().cast("array<string>") if warnings is None else warnings).alias("warnings"),
    )
    out = base.join(t, list(key), "left").join(r, list(key), "left")
    return out.withColumns({
        "tasks_generated": F.coalesce("tasks_generated", F.array().cast(t.schema["tasks_generated"].dataType)),
        "threat_responses": F.coalesce("threat_responses", F.array().cast(r.schema["threat_responses"].dataType)),
    })

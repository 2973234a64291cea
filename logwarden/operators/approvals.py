"""Approval routing, requests, and the outcome of ordered decisions.

State is derived from append-only tables; nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import literal
from ..functions.crypto import content_id
from ..functions.text import text
from ..schemas import CHAIN_STEP, ROUTING_RULE
from .integrity import task_content_hash
from .tasks import unhandled, unhandled_error

# Fixed value: the chain of a task no routing rule covers.
DEFAULT_CHAIN = [{"step_order": 1, "role": "approver", "required": True}]


def route_approvals(
    tasks: DataFrame, rules: Sequence[dict], level: str = "source_level", event: str = "event_name",
) -> DataFrame:
    """First rule for the event with the level in range, else first wildcard, else one step."""
    shape = T.ArrayType(ROUTING_RULE)
    by_event: dict[str, list[dict]] = {}
    for r in rules:
        if r["event_name"]:
            by_event.setdefault(r["event_name"], []).append(r)
    exact = F.try_element_at(literal(by_event, T.MapType(T.StringType(), shape)), F.col(event))
    wild = literal([r for r in rules if not r["event_name"]], shape)

    def in_range(r: Column) -> Column:
        return F.col(level).between(r["min_level"], r["max_level"])

    rule = F.coalesce(
        F.get(F.filter(exact, in_range), F.lit(0)),
        F.get(F.filter(wild, in_range), F.lit(0)),
    )
    default = literal(DEFAULT_CHAIN, T.ArrayType(CHAIN_STEP))
    return tasks.withColumn("_route", rule).withColumns({
        "route_rule_id": F.coalesce(F.col("_route.rule_id"), F.lit("")),
        "chain": F.when(F.col("_route").isNotNull(), F.col("_route.chain")).otherwise(default),
    }).drop("_route")


def create_approvals(tasks: DataFrame, requested_at: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One pending request per blocked task; expects routed tasks."""
    blocked = task_content_hash(tasks.filter(F.col("status") == "blocked_approval"))
    return blocked.select(
        content_id(F.lit("approval"), F.col("task_id")).alias("approval_id"),
        "task_id",
        (F.col("created_at") if requested_at is None else requested_at).alias("requested_at"),
        F.lit("pending").alias("status"),
        "content_hash",
        F.lit(1).alias("current_step"),
        F.greatest(F.size("chain"), F.lit(1)).alias("total_steps"),
        *carry,
    )


def longest_chain(rules: Sequence[dict]) -> int:
    """The most decisions any request made under these rules can take."""
    return max([1, *(len(r["chain"]) for r in rules)])


def _usable(decisions: DataFrame) -> Column:
    return (text("task_id") != "") & (text("actor_id") != "") & F.col("action").isin("approved", "rejected")


def accepted_decisions(requests: DataFrame, decisions: DataFrame, max_steps: int | None = None) -> DataFrame:
    """Decisions that count, with their step.

    A request takes at most ``total_steps`` decisions, so only the first few of a
    task matter; the rank filter drops the rest before the shuffle, however many
    decisions one task has.  ``max_steps`` must be no less than any
    ``total_steps`` (``longest_chain`` of the routing rules); left out, it is
    read from the requests.
    """
    if max_steps is None:
        max_steps = requests.agg(F.max("total_steps")).first()[0] or 1
    order = Window.partitionBy("task_id").orderBy("decided_at", "seq")
    first = (
        decisions.filter(_usable(decisions))
        .withColumn("step_order", F.row_number().over(order))
        .filter(F.col("step_order") <= max_steps)
    )
    req = requests.select("task_id", "approval_id", "content_hash", "total_steps")
    rejected_before = F.coalesce(F.sum(F.when(F.col("action") == "rejected", 1).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        first.join(req, "task_id")
        .withColumn("_rejected", rejected_before)
        .filter((F.col("_rejected") == 0) & (F.col("step_order") <= F.col("total_steps")))
        .drop("_rejected")
    )


def step_records(accepted: DataFrame) -> DataFrame:
    """The append-only audit rows of accepted decisions."""
    return accepted.select(
        content_id(F.lit("step"), F.col("approval_id"), F.col("step_order").cast("string")).alias("record_id"),
        "approval_id", "task_id", "step_order", "action", "actor_id", text("actor_role").alias("actor_role"),
        text("reason").alias("reason"), "content_hash", F.col("decided_at").alias("created_at"),
    )


def apply_approvals(requests: DataFrame, accepted: DataFrame) -> DataFrame:
    """Requests with the state the accepted decisions lead to."""
    seen = accepted.groupBy("task_id").agg(
        F.count_if(F.col("action") == "approved").alias("_ok"),
        F.max(F.col("action") == "rejected").alias("_no"),
        F.max(F.struct("decided_at", "seq")).alias("_last"),
    )
    ok, no = F.coalesce(F.col("_ok"), F.lit(0)), F.coalesce(F.col("_no"), F.lit(False))
    status = (
        F.when(no, "rejected").when(ok >= F.col("total_steps"), "approved")
        .when(ok > 0, "in_review").otherwise(F.col("status"))
    )
    done = no | (ok >= F.col("total_steps"))
    return requests.join(seen, "task_id", "left").withColumns({
        "status": status,
        "current_step": F.least(ok + 1, F.col("total_steps")).cast("int"),
        "resolved_at": F.when(done, F.col("_last.decided_at")),
        "resolved_seq": F.when(done, F.col("_last.seq")),
    }).drop("_ok", "_no", "_last")


def refused_decisions(decisions: DataFrame, states: DataFrame) -> DataFrame:
    """Decisions that had no effect, each with the reason."""
    s = states.select("task_id", F.col("status").alias("_status"), F.lit(True).alias("_known"),
                      F.struct("resolved_at", "resolved_seq").alias("_end"),
                      F.col("resolved_at").isNotNull().alias("_done"))
    late = F.col("_done") & (F.struct("decided_at", "seq") > F.col("_end"))
    reason = (
        F.when((text("task_id") == "") | (text("actor_id") == ""), "task_id and actor_id are required")
        .when(~F.col("action").isin("approved", "rejected"), "unknown action")
        .when(F.col("_known").isNull(), "approval request not found")
        .when(late, F.concat(F.lit("approval status is "), F.col("_status")))
    )
    return (
        decisions.join(s, "task_id", "left").withColumn("error", reason)
        .filter(F.col("error").isNotNull()).drop("_status", "_known", "_end", "_done")
    )


def approved_tasks(tasks: DataFrame, states: DataFrame, handled: Sequence[str] = (), has_default: bool = False) -> DataFrame:
    """Tasks with the status and error their approval leads to.

    Approved ones are dispatched as ``dispatch_outcome`` does: an action that must be
    handled and is not fails.
    """
    s = states.select("task_id", F.col("status").alias("_state"))
    approved = F.col("_state") == "approved"
    failed = approved & unhandled(handled, has_default)
    before = text("error") if "error" in tasks.columns else F.lit("")
    return tasks.join(s, "task_id", "left").withColumns({
        "error": F.when(failed, unhandled_error()).when(approved, "").otherwise(before),
        "status": F.when(failed, "failed").when(approved, "dispatched")
        .when(F.col("_state") == "rejected", "rejected").otherwise(F.col("status")),
    }).drop("_state")


def check_tampering(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests whose task no longer has the content it was requested for."""
    now = task_content_hash(tasks, "current_hash").select("task_id", "current_hash")
    both = requests.join(now, "task_id")
    return both.filter((F.col("content_hash") != "") & (F.col("content_hash") != F.col("current_hash")))


def approval_history(records: DataFrame, approval_id: str | Column) -> DataFrame:
    return records.filter(F.col("approval_id") == approval_id).orderBy("step_order", "created_at")


def task_modifications(changes: DataFrame, task_id: str | Column) -> DataFrame:
    return changes.filter(F.col("task_id") == task_id).orderBy("created_at", "field")


def derive_modifications(old: DataFrame, new: DataFrame, fields: Sequence[str], by: str, at: str) -> DataFrame:
    """Field-level change rows between two versions of tasks."""
    pairs = F.array(*[F.struct(
        F.lit(f).alias("field"), F.col(f"_old_{f}").cast("string").alias("old_value"),
        F.col(f).cast("string").alias("new_value")) for f in fields])
    before = old.select("task_id", *[F.col(f).alias(f"_old_{f}") for f in fields])
    both = task_content_hash(new).join(before, "task_id")
    return (
        both.select("task_id", F.col(by).alias("modified_by"), F.col(at).alias("created_at"), "content_hash",
                    F.inline(pairs))
        .filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
        .withColumn("modification_id", content_id(
            F.col("task_id"), F.col("field"), F.unix_micros("created_at").cast("string"), F.col("new_value")))
    )


def current_status(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest status and error per task from append-only updates."""
    latest = updates.groupBy("task_id").agg(
        F.max_by(F.struct("status", "error", "updated_at"), F.struct("updated_at", "seq")).alias("_u"))
    return tasks.join(latest, "task_id", "left").withColumns({
        "status": F.coalesce(F.col("_u.status"), F.col("status")),
        "error_message": text(F.col("_u.error")),
        "updated_at": F.coalesce(F.col("_u.updated_at"), F.col("created_at")),
    }).drop("_u")

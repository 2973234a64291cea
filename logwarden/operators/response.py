"""Threat response: strategy, target, blocks, analysis, records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import literal
from ..functions.crypto import content_id
from ..functions.severity import priority_rank
from ..functions.text import actor_or, tag_value, text
from ..schemas import ANALYSIS, PRIORITIES, RESPONSE_RULE

DEFAULT_PROMPT = "Analyze this security detection event and provide risk assessment."
BUILTIN_ACTIONS = ("block_ip", "lock_account")
NO_IP = ("", "0.0.0.0")


def match_response_rule(detections: DataFrame, rules: Sequence[dict], default_strategy: str) -> DataFrame:
    """Add ``response_rule`` (nullable) and ``strategy``.

    First rule of the event whose minimum priority is met, else the first
    wildcard whatever its minimum, else the default strategy.
    """
    ranked = T.StructType([T.StructField("rank", T.IntegerType()), *RESPONSE_RULE.fields])

    def rank(r: dict) -> int:
        if not r["min_priority"]:
            return -1
        return PRIORITIES.index(r["min_priority"]) if r["min_priority"] in PRIORITIES else 0

    table = [{**r, "rank": rank(r)} for r in rules]
    by_event: dict[str, list[dict]] = {}
    for r in table:
        if r["event_name"]:
            by_event.setdefault(r["event_name"], []).append(r)
    exact = F.try_element_at(literal(by_event, T.MapType(T.StringType(), T.ArrayType(ranked))), F.col("event_name"))
    wild = literal([r for r in table if not r["event_name"]][:1], T.ArrayType(ranked))
    rule = F.coalesce(
        F.get(F.filter(exact, lambda r: r["rank"] <= priority_rank(F.col("priority"))), F.lit(0)),
        F.get(wild, F.lit(0)),
    )
    return detections.withColumn("response_rule", rule).withColumn(
        "strategy", F.coalesce(F.col("response_rule.strategy"), F.lit(default_strategy)))


def extract_target(df: DataFrame) -> DataFrame:
    """Add ``target``: ip, user_id, boundary, metric_key, resource_id."""
    p = F.col("payload")
    tag_ip = tag_value(F.col("tags"), "ip", "")
    ip = F.when(p["kind"] == "security_intrusion", text(p["ip"])).otherwise("")
    compliance = p["kind"] == "compliance_violation"
    return df.withColumn("target", F.struct(
        F.when(ip.isin(*NO_IP), tag_ip).otherwise(ip).alias("ip"),
        F.when(compliance, text(p["user_id"])).otherwise(actor_or(F.col("actor_id"), "")).alias("user_id"),
        text("boundary").alias("boundary"),
        F.when(p["kind"] == "anomaly", text(p["metric_key"])).otherwise("").alias("metric_key"),
        F.when(compliance, text(p["document_id"])).otherwise("").alias("resource_id"),
    ))


def expand_strategy(df: DataFrame) -> DataFrame:
    """Add ``do_analyze``, ``do_block``, ``do_notify``; MONITOR does nothing."""
    s = F.col("strategy")
    return df.withColumns({
        "do_analyze": s.isin("BLOCK_AND_NOTIFY", "ANALYZE_AND_NOTIFY"),
        "do_block": s.isin("BLOCK_AND_NOTIFY", "BLOCK_ONLY"),
        "do_notify": s.isin("BLOCK_AND_NOTIFY", "ANALYZE_AND_NOTIFY", "NOTIFY_ONLY"),
    })


def block_result(action: Column, ip: Column, user_id: Column, actions: Sequence[str]) -> Column:
    """What executing a block gives: action_type, target, success, error."""
    def result(target: Column, error: Column) -> Column:
        return F.struct(action.alias("action_type"), target.alias("target"),
                        (error == "").alias("success"), error.alias("error"))

    return (
        F.when(~action.isin(*actions), result(
            ip, F.concat(F.lit("no block action registered for type: "), action)))
        .when(action == "block_ip", result(
            ip, F.when(ip.isin(*NO_IP), "no valid IP to block").otherwise("")))
        .when(action == "lock_account", result(
            user_id, F.when(user_id == "", "no user ID to lock").otherwise("")))
        .otherwise(result(ip, F.lit("")))
    )


def block_action() -> Column:
    return F.coalesce(F.nullif(F.col("response_rule.block_action"), F.lit("")), F.lit("block_ip"))


def plan_blocks(df: DataFrame, actions: Sequence[str] = BUILTIN_ACTIONS) -> DataFrame:
    """Add ``block``: the outcome where the strategy blocks, null elsewhere."""
    t = F.col("target")
    body = block_result(block_action(), t["ip"], t["user_id"], actions)
    return df.withColumn("block", F.when(F.col("do_block"), body))


def block_mode(
    df: DataFrame, mode: str, actions: Sequence[str] = BUILTIN_ACTIONS, created_at: Column | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(detections with ``block``, pending rows or None).

    With REQUIRE_APPROVAL nothing is executed: blocks wait as pending rows.
    """
    if mode == "IMMEDIATE":
        return plan_blocks(df, actions), None
    if mode != "REQUIRE_APPROVAL":
        raise ValueError(f"unknown block mode: {mode}")
    t = F.col("target")
    waiting = F.struct(block_action().alias("action_type"), t["ip"].alias("target"),
                       F.lit(False).alias("success"), F.lit("awaiting approval").alias("error"))
    marked = df.withColumn("block", F.when(F.col("do_block"), waiting))
    pending = df.filter("do_block").select(
        content_id(F.lit("block"), F.col("trace_id"), F.col("event_name"), F.col("rule_pos").cast("string"))
        .alias("block_id"),
        block_action().alias("action_type"), t["ip"].alias("target_ip"), t["user_id"].alias("target_user_id"),
        t["boundary"].alias("boundary"), F.col("event_name").alias("reason"), F.lit("pending").alias("status"),
        (F.col("timestamp") if created_at is None else created_at).alias("created_at"),
    )
    return marked, pending


def block_rows(df: DataFrame) -> DataFrame:
    """The blocks of ``plan_blocks`` as rows of a block table: what is blocked, since when, and how it went.

    ``ip`` and ``blocked_at`` are what ``flag_blocked_traffic`` and ``active_blocks`` look up.
    """
    b, t = F.col("block"), F.col("target")
    return df.filter(b.isNotNull()).select(
        content_id(F.lit("block"), F.col("trace_id"), F.col("event_name"), F.col("rule_pos").cast("string")).alias("block_id"),
        b["action_type"].alias("action_type"), F.when(b["success"] & (b["action_type"] != "lock_account") & ~t["ip"].isin(*NO_IP), t["ip"]).otherwise("").alias("ip"),
        b["target"].alias("target"), b["success"].alias("success"), text(b["error"]).alias("error"), F.col("event_name").alias("reason"),
        F.col("trace_id"), F.col("timestamp").alias("blocked_at"))


def resolve_blocks(pending: DataFrame, decisions: DataFrame, actions: Sequence[str] = BUILTIN_ACTIONS) -> DataFrame:
    """Pending blocks with status, resolver and, once approved, the block outcome.

    Only the first decision of a block counts; the rank filter reduces the
    decisions before they are shuffled.
    """
    first = (
        decisions.filter(F.col("action").isin("approved", "rejected"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy("block_id").orderBy("decided_at", "seq")))
        .filter(F.col("_rn") == 1)
        .select("block_id", F.col("action").alias("_action"), F.col("actor_id").alias("_by"),
                F.col("decided_at").alias("_at"))
    )
    result = block_result(F.col("action_type"), F.col("target_ip"), F.col("target_user_id"), actions)
    return pending.join(first, "block_id", "left").withColumns({
        "status": F.coalesce("_action", "status"),
        "resolved_by": text("_by"),
        "resolved_at": F.col("_at"),
        "block": F.when(F.col("_action") == "approved", result),
    }).drop("_action", "_by", "_at")


def pending_count(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count_if(F.col("status") == "pending").alias("n_pending"))


# --- block lists ----------------------------------------------------------

def active_blocks(blocks: DataFrame, unblocks: DataFrame | None, as_of: Column, ttl_sec: int = 0) -> DataFrame:
    """Addresses blocked at ``as_of``: latest block, not expired, not lifted since.

    ``blocks``: ip, blocked_at.  ``unblocks``: ip, unblocked_at.  0 = for ever.
    """
    live = blocks.filter(F.col("blocked_at") <= as_of).groupBy("ip").agg(F.max("blocked_at").alias("blocked_at"))
    if ttl_sec > 0:
        live = live.filter(F.unix_micros(as_of) - F.unix_micros("blocked_at") <= ttl_sec * 1_000_000)
    if unblocks is not None:
        lifted = unblocks.filter(F.col("unblocked_at") <= as_of).groupBy("ip").agg(
            F.max("unblocked_at").alias("_lifted"))
        live = live.join(lifted, "ip", "left").filter(
            F.col("_lifted").isNull() | (F.col("_lifted") < F.col("blocked_at"))).drop("_lifted")
    return live


def flag_blocked_traffic(
    logs: DataFrame, blocks: DataFrame, ttl_sec: int = 0, ip: str = "ip", us: str = "event_us",
    slice_sec: int = 3600, carry: Sequence[str] = ("trace_id",), lifts: DataFrame | None = None,
) -> DataFrame:
    """Was the address of an event blocked at that moment: an as-of lookup.

    ``lifts`` has ip and lifted_at; the latest of block and lift holds, a lift at the
    moment of a block wins.

    Traffic and blocks are cut into time slices per address, so a busy address is
    spread out; the latest block before a slice comes from one row per slice.
    Rows without an address are not shuffled.
    """
    unit = slice_sec * 1_000_000
    moves = blocks.select(F.col("ip").alias("_ip"), F.unix_micros("blocked_at").alias("_at"), F.lit(0).alias("_lift"))
    if lifts is not None:
        moves = moves.unionByName(lifts.select(F.col("ip").alias("_ip"), F.unix_micros("lifted_at").alias("_at"), F.lit(1).alias("_lift")))
    moves = moves.filter(text("_ip") != "")
    known = logs.filter(text(ip) != "")
    sliced = lambda c: F.floor(c / F.lit(unit)).cast("bigint")
    carried = [F.col(c).alias(c) for c in carry]
    empty = [F.lit(None).cast(logs.schema[c].dataType).alias(c) for c in carry]
    points = known.select(F.col(ip).alias("_ip"), F.col(us).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_lift"), *carried).unionByName(
        moves.select("_ip", "_at", F.lit(0).alias("_kind"), "_lift", *empty)).withColumn("_slice", sliced(F.col("_at")))

    # Twice the time, plus 1 for a lift: the greatest is the latest move.
    block_at = F.when(F.col("_kind") == 0, F.col("_at") * 2 + F.col("_lift"))
    before = points.groupBy("_ip", "_slice").agg(F.max(block_at).alias("_m")).withColumn("_before", F.max("_m").over(
        Window.partitionBy("_ip").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    local = Window.partitionBy("_ip", "_slice").orderBy("_at", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = (
        points.withColumn("_local", F.max(block_at).over(local)).join(before, ["_ip", "_slice"])
        .filter(F.col("_kind") == 1)
        .withColumn("_move", F.coalesce("_local", "_before"))
        .withColumn("blocked_at_us", F.when(F.col("_move").bitwiseAND(1) == 0, F.shiftright("_move", 1)))
    )
    inside = F.col("blocked_at_us").isNotNull()
    if ttl_sec > 0:
        inside = inside & (F.col("_at") - F.col("blocked_at_us") <= ttl_sec * 1_000_000)
    flagged = found.select(
        *carry, F.col("_ip").alias("ip"), F.col("_at").alias("event_us"), "blocked_at_us",
        F.coalesce(inside, F.lit(False)).alias("is_blocked"))
    rest = logs.filter(text(ip) == "").select(
        *carry, F.lit("").alias("ip"), F.col(us).alias("event_us"),
        F.lit(None).cast("bigint").alias("blocked_at_us"), F.lit(False).alias("is_blocked"))
    return flagged.unionByName(rest)


# --- analysis by a user function ------------------------------------------

def analyze(df: DataFrame, fn: Callable[[str, dict], dict]) -> DataFrame:
    """Add ``analysis`` where the strategy asks for it, by a user function.

    Only the eight columns the function sees travel to Python, in Arrow batches.
    An error is kept in the row.
    """
    names = [f.name for f in ANALYSIS.fields]

    @F.pandas_udf(ANALYSIS)
    def run(wanted: pd.Series, prompt: pd.Series, ctx: pd.DataFrame) -> pd.DataFrame:
        out = []
        for want, p, row in zip(wanted, prompt, ctx.to_dict("records")):
            if not want:
                out.append(dict.fromkeys(names))
                continue
            try:
                out.append({**dict.fromkeys(names), "error": "", **fn(p, row)})
            except Exception as e:  # noqa: BLE001 - the error is the result
                out.append({**dict.fromkeys(names), "error": f"analysis failed: {e}"})
        return pd.DataFrame(out, columns=names)

    prompt = F.coalesce(F.nullif(F.col("response_rule.analysis_prompt"), F.lit("")), F.lit(DEFAULT_PROMPT))
    context = F.struct("event_name", "priority", "score", "message", "boundary", "level", "type")
    called = df.withColumn("_analysis", run(F.col("do_analyze"), prompt, context))
    return called.withColumn("analysis", F.when(F.col("do_analyze"), F.col("_analysis"))).drop("_analysis")


# --- records --------------------------------------------------------------

def threat_responses(
    detections: DataFrame, rules: Sequence[dict], default_strategy: str = "NOTIFY_ONLY", mode: str = "IMMEDIATE",
    analyzer: Callable[[str, dict], dict] | None = None, actions: Sequence[str] = BUILTIN_ACTIONS,
    carry: Sequence[str] = (), id_cols: Sequence[str] = ("trace_id",),
) -> DataFrame:
    """One response record per detection."""
    df = expand_strategy(extract_target(match_response_rule(detections, rules, default_strategy)))
    df = block_mode(df, mode, actions)[0]
    df = analyze(df, analyzer) if analyzer else df.withColumn("analysis", F.lit(None).cast(ANALYSIS))
    response_id = content_id(
        F.lit("response"), *[F.col(c).cast("string") for c in id_cols], F.col("event_name"), F.col("rule_id"),
        F.col("rule_pos").cast("string"))
    return df.select(
        response_id.alias("response_id"), "trace_id", "event_name", "rule_pos", "strategy", "target", "block", "analysis",
        F.col("do_notify").alias("notified"),
        F.coalesce(F.get("response_rule.notify_targets", F.lit(0)), F.lit("")).alias("notify_target"),
        F.col("timestamp").alias("created_at"), *carry,
    )


def flat_responses(records: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The stored form: nested parts flattened, absent parts blank."""
    b, a, t = F.col("block"), F.col("analysis"), F.col("target")
    done = a.isNotNull() & (text(a["error"]) == "")
    return records.select(
        "response_id", "trace_id", "event_name", "rule_pos", "strategy", t["ip"].alias("target_ip"),
        t["user_id"].alias("target_user_id"), t["boundary"].alias("boundary"),
        text(b["action_type"]).alias("block_action"), F.coalesce(b["success"], F.lit(False)).alias("block_success"),
        text(b["target"]).alias("block_target"), done.alias("analyzed"),
        F.when(done, text(a["risk_level"])).otherwise("").alias("risk_level"),
        F.when(done, F.coalesce(a["confidence"], F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(done, text(a["summary"])).otherwise("").alias("analysis_summary"),
        "notified", "notify_target", "created_at", *carry,
    )


def response_summary(records: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The short form that goes into a log's result."""
    f = flat_responses(records, carry)
    return f.select(
        "response_id", "trace_id", "event_name", "rule_pos", "strategy", F.col("block_success").alias("blocked"),
        "block_target", "analyzed", "risk_level", "notified", *carry)

"""The whole flow, stage by stage.

``prepare`` -> ``detections_of`` -> ``respond`` / ``assign`` -> ``results``.
Each stage is a plain function over DataFrames.  ``run_batch`` puts a written
table between the stages, so that masking and hashing are computed once, later
stages read only the columns they need, and a lost executor costs a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RuleSet
from ..functions.text import utc_date
from ..operators import access, agents, anomaly, approvals, dedup, detect, integrity, masking, normalize
from ..operators import outbox, response, tasks
from ..schemas import CHAIN_HEADS as HEADS
from ..schemas import DETECTION
from ..sources import sinks

KEY = ("trace_id",)

#: What identifies one log of a stored batch: many logs can share a trace id.
ROW = ("trace_id", sinks.ROW_ID)


@dataclass
class Prepared:
    logs: DataFrame
    rejected: DataFrame
    denied: DataFrame | None = None


def mask(logs: DataFrame, rules: RuleSet) -> DataFrame:
    """Mask by policy or by the fixed rules, then mask again what leaked."""
    if not rules.enable_masking:
        return logs
    if rules.masking_policies:
        out = masking.mask_with_policies(
            logs, rules.masking_policies, rules.masking_rules, rules.preserve_fields, keep_variant=True)
        if rules.verify_masking:
            out = masking.remask_leaks(out, F.col("_preserve"))
        return out.drop("_variant", "_preserve")
    out = masking.mask_log(logs, rules.masking_rules, rules.preserve_fields)
    return masking.remask_leaks(out, rules.preserve_fields) if rules.verify_masking else out


def prepare(raw: DataFrame, rules: RuleSet, now: Column | None = None, tell_apart: bool = False) -> Prepared:
    """Authorise on the raw values, reject, normalise, mask: one narrow stage.

    With ``tell_apart`` equal records without a trace id get different ones; the result must then
    be written before it is used twice.
    """
    denied = None
    if rules.authorization:
        raw, denied = access.authorize_writes(raw, rules.client_roles, rules.roles, rules.default_role)
    valid, rejected = normalize.split_valid(normalize.conform(raw))
    nth = F.monotonically_increasing_id() if tell_apart else None
    # What is refused is stored as well, so it is masked like the rest.
    refused = None if denied is None else mask(normalize.conform(denied), rules)
    return Prepared(mask(normalize.normalize(valid, rules.service_id, now, nth), rules), mask(rejected, rules), refused)


CHAIN = ("service_id", "boundary", "chain_date")


def chain(logs: DataFrame, rules: RuleSet, order: Sequence[str], heads: DataFrame | None = None) -> DataFrame:
    """Hash chains per service, boundary and day, continued from ``heads``."""
    if not rules.enable_hash_chain:
        return logs
    dated = logs.withColumn(CHAIN[-1], utc_date(F.col("timestamp")).cast("string"))
    return integrity.build_hash_chain(dated, CHAIN, order, rules.hmac_key, heads=heads)


def with_day(heads: DataFrame) -> DataFrame:
    """The day of a chain as a time, whatever the zone of the session."""
    return heads.withColumn("chain_day", F.timestamp_micros(F.unix_date(F.to_date("chain_date")).cast("bigint") * 86_400_000_000))


def heads_before(logs: DataFrame, root: str, batch_id: int | str) -> DataFrame:
    """The chain heads a batch starts from, of the days it has logs of.

    They are stored with the batch: when it is run again, it starts from the same heads,
    whatever came after it.  A batch that is not the last may only be run again with the same logs.
    """
    spark = logs.sparkSession
    stored = sinks.batch_table(spark, root, "chain_starts", batch_id, HEADS)
    if stored is not None:
        return stored
    days = logs.agg(F.min(utc_date(F.col("timestamp"))).alias("lo"), F.max(utc_date(F.col("timestamp"))).alias("hi")).first()
    heads = sinks.read_table(spark, root, "chain_heads", T.StructType([*HEADS.fields, T.StructField("head_signature", T.StringType())]))
    if days.lo is not None:  # logs without a time get that of now, which may be a day later when they are written
        heads = heads.filter(F.col(sinks.DATE).between(F.lit(days.lo), F.date_add(F.lit(days.hi), 1)))
    before = integrity.last_heads(heads.filter(F.col(sinks.BATCH) != str(batch_id)), CHAIN).select(*HEADS.fieldNames())
    sinks.append_table(with_day(before), root, "chain_starts", batch_id, "chain_day")
    return sinks.batch_table(spark, root, "chain_starts", batch_id, HEADS)


def store_heads(logs: DataFrame, rules: RuleSet, root: str, batch_id: int | str) -> None:
    """The signed heads after a batch."""
    heads = integrity.chain_heads(logs, CHAIN, [integrity.SEQ], rules.hmac_key)
    sinks.append_table(with_day(heads), root, "chain_heads", batch_id, "chain_day")


def detections_of(logs: DataFrame, rules: RuleSet, key: Sequence[str] = KEY) -> DataFrame:
    """Detection rows with the columns of their log."""
    if not rules.ensemble:
        found = detect.detect_first(logs)
    else:
        fired = detect.detect_ensemble(logs, detect.ensemble_rules(rules.dynamic_rules))
        if rules.dedup_window_sec > 0:
            kept = dedup.dedup_detections(
                detect.explode_detections(fired), rules.dedup_window_sec, order_cols=(*key, "rule_pos"))
            found = detect.threshold_rows(kept, rules.aggregator, rules.threshold, key)
        else:
            found = detect.explode_detections(detect.apply_threshold(fired, rules.aggregator, rules.threshold))
        found = found.drop("aggregate_score")
    if rules.anomaly:
        found = found.unionByName(anomalies_of(logs, rules, key))
    return found


def anomalies_of(logs: DataFrame, rules: RuleSet, key: Sequence[str] = KEY) -> DataFrame:
    """Anomaly detections joined back to the few logs that raised them."""
    rows = anomaly.detect_anomaly(
        logs, rules.anomaly_window_sec, rules.anomaly_baseline_sec, rules.anomaly_threshold_pct,
        rules.anomaly_min_baseline, order=key[0], carry=key[1:])
    return logs.join(rows.select(*key, *[f.name for f in DETECTION.fields]), list(key))


def respond(
    detections: DataFrame, rules: RuleSet, analyzer: Callable[[str, dict], dict] | None = None,
    carry: Sequence[str] = (), id_cols: Sequence[str] = KEY,
) -> DataFrame:
    return response.threat_responses(
        detections, rules.response_rules, rules.default_strategy, rules.block_mode, analyzer, carry=carry, id_cols=id_cols)


def assign(
    detections: DataFrame, rules: RuleSet, now: Column | None = None, handled: Sequence[str] = (),
    has_default: bool = True, carry: Sequence[str] = (), id_cols: Sequence[str] = KEY,
) -> DataFrame:
    """Tasks with status, error and approval chain."""
    made = tasks.dispatch_status(tasks.generate_tasks(detections, rules.task_rules, now, carry, id_cols))
    return approvals.route_approvals(tasks.dispatch_outcome(made, handled, has_default), rules.routing_rules)


def notify(records: DataFrame, rules: RuleSet, routing: dict[str, Sequence[str]], types: Sequence[str],
           secret: bytes = b"") -> DataFrame:
    rows = outbox.notification_rows(records, rules.brand)
    return outbox.render_payload(outbox.route_notifications(rows, routing, types), rules.brand, secret=secret)


def delegate(made: DataFrame, rules: RuleSet, model: Callable[[dict], dict]) -> DataFrame:
    chosen = agents.delegate_tasks(made, rules.allowed_actions, rules.min_severity)
    return agents.infer(agents.loop_guard(chosen, rules.max_loop_depth), model, rules.agent_provider)


# Which channel names go to which channel types by default.
DEFAULT_ROUTING = {"https://": ["webhook"], "#": ["slack"], "@": ["gmail"]}


def run_batch(
    raw: DataFrame, rules: RuleSet, root: str, batch_id: int | str, order: Sequence[str] = ("timestamp", "trace_id"),
    analyzer: Callable[[str, dict], dict] | None = None, model: Callable[[dict], dict] | None = None,
    routing: dict[str, Sequence[str]] | None = None, types: Sequence[str] = outbox.CHANNEL_TYPES,
    handled: Sequence[str] = (), has_default: bool = True,
) -> DataFrame:
    """Run one batch into the tables under ``root``; return the result per log, by trace_id and row_id.

    A repeated batch id replaces the rows of its first attempt.
    """
    if rules.agent and model is None:
        raise ValueError("agents are enabled: pass the function that calls the model")
    spark = raw.sparkSession
    ready = prepare(raw, rules, tell_apart=True)
    sinks.append_table(ready.rejected, root, "rejected_logs", batch_id, "timestamp")
    if ready.denied is not None:
        sinks.append_table(ready.denied, root, "denied_logs", batch_id, "timestamp")
    heads = heads_before(ready.logs, root, batch_id) if rules.enable_hash_chain else None
    marked = sinks.append_logs(
        chain(ready.logs, rules, order, heads), root, batch_id, rules.fail_on_persist_error, order)

    def stored(df: DataFrame, table: str, date_from: str | None = None) -> DataFrame:
        """Append the rows and read them again; a batch without rows is an empty table."""
        sinks.append_table(df, root, table, batch_id, date_from)
        path = f"{sinks.table_path(root, table)}/{sinks.BATCH}={batch_id}"
        return spark.read.schema(df.schema).parquet(path).select(*df.columns)

    # Refused rows are looked at all the same: only their storage failed.
    logs = sinks.staged_logs(spark, root, batch_id)
    if rules.enable_hash_chain:
        store_heads(logs, rules, root, batch_id)
    found = stored(detections_of(logs, rules, ROW), "detections")

    made = assign(found, rules, F.col("source_timestamp"), handled, has_default, [sinks.ROW_ID], ROW)
    made = stored(made, "assigned", "created_at")
    sinks.append_tasks(made, root, batch_id)
    sinks.append_table(made.select("task_id", "rule_id", "status", "error", F.col("created_at").alias("dispatched_at")),
                       root, "task_results", batch_id)
    requests = approvals.create_approvals(made)
    sinks.append_table(requests, root, "approvals", batch_id)

    if rules.response:
        records = stored(respond(found, rules, analyzer, [sinks.ROW_ID], ROW), "responded", "created_at")
        sinks.append_table(response.flat_responses(records), root, "threat_responses", batch_id)
        sinks.append_table(notify(records, rules, routing or DEFAULT_ROUTING, types), root, "outbox", batch_id)
        if rules.block_mode == "REQUIRE_APPROVAL":
            planned = response.expand_strategy(response.extract_target(
                response.match_response_rule(found, rules.response_rules, rules.default_strategy)))
            sinks.append_table(response.block_mode(planned, rules.block_mode)[1], root, "pending_blocks", batch_id)
        summaries = response.response_summary(records, [sinks.ROW_ID])
    else:
        summaries = response.response_summary(respond(found, rules, carry=[sinks.ROW_ID], id_cols=ROW).limit(0), [sinks.ROW_ID])
    if rules.agent:
        runs = delegate(made, rules, model)
        done = stored(runs, "agent_runs", "source_timestamp")
        sinks.append_table(agents.agent_task_results(done), root, "agent_task_results", batch_id, "dispatched_at")
        sinks.append_table(agents.own_trace_ids(agents.agent_results_to_logs(done)), root, "agent_logs", batch_id, "timestamp")
    warnings = F.when(F.col("degraded"), F.array("warning")).otherwise(F.array().cast("array<string>"))
    return tasks.ingestion_result(
        marked, made.withColumn("trace_id", F.col("source_trace_id")), summaries, rules.enable_hash_chain,
        rules.enable_masking, ROW, warnings)

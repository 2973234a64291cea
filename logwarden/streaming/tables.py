"""Streams whose state lives in tables: one ``foreachBatch`` per query.

Each micro-batch runs the batch forms of the operators, which cut busy keys into
slices and lanes.  What must be carried over (chain heads, last kept times, the
times of recent batches) is a small snapshot every batch writes and the next one
reads: nothing has to list or read the whole history, and a replayed batch reads
the same snapshot and replaces its own rows.

A root folder belongs to one checkpoint: batch ids name the folders in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import RuleSet
from ..functions.text import utc_date
from ..operators import agents, anomaly, approvals, dedup, detect, integrity, normalize, outbox, response, tasks
from ..plans import flow
from ..schemas import CHAIN_HEADS as HEADS
from ..schemas import DETECTION, LOG_SCHEMA
from ..sources import sinks

KEPT = T.StructType([T.StructField("key", T.StringType()), T.StructField("last_us", T.LongType())])
MARKS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("max_us", T.LongType())])
ROWS = T.StructType([*LOG_SCHEMA.fields, T.StructField(sinks.ROW_ID, T.StringType())])
CHAIN = ["service_id", "boundary", "chain_date"]
ORDER = ["timestamp", "trace_id"]
STAMP = "stamp"


def split_late(df: DataFrame, watermark_us: Column | int | None, time_col: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows older than the watermark); a row without a time counts as new."""
    if watermark_us is None:
        return df, df.limit(0)
    late = F.coalesce(F.unix_micros(time_col) < watermark_us, F.lit(False))
    return df.filter(~late), df.filter(late)


@dataclass
class StreamFlow:
    """The flow as a ``foreachBatch`` function over raw log records.

    ``handlers`` run over the dispatched tasks of an action, ``on_logs`` over
    every processed batch, ``blocker`` over the blocks of a batch, ``feedback`` is the folder agent logs go to so that
    the same stream reads them again.
    """

    rules: RuleSet
    root: str
    lanes: int = 8
    delay_sec: int = 600
    analyzer: Callable[[str, dict], dict] | None = None
    model: Callable[[dict], dict] | None = None
    handlers: dict[str, Sequence[Callable[[DataFrame], None]]] = field(default_factory=dict)
    default_handler: Callable[[DataFrame], None] | None = None
    on_logs: Callable[[DataFrame], None] | None = None
    notifier: Callable[[DataFrame], None] | None = None
    blocker: Callable[[DataFrame], None] | None = None
    routing: dict[str, Sequence[str]] = field(default_factory=lambda: dict(flow.DEFAULT_ROUTING))
    channel_types: Sequence[str] = outbox.CHANNEL_TYPES
    feedback: str | None = None
    # Look for repeated trace ids only in batches this recent; None searches all.
    unique_sec: int | None = None

    # --- state ------------------------------------------------------------

    def __post_init__(self) -> None:
        if self.rules.agent and self.model is None:
            raise ValueError("agents are enabled: pass the function that calls the model")

    def _snapshot(self, spark, table: str, schema: T.StructType, batch_id: int) -> DataFrame:
        """The snapshot the batch before this one wrote."""
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(
            f"{sinks.table_path(self.root, table)}/{sinks.BATCH}={batch_id - 1}").select(*schema.fieldNames())

    def _write(self, df: DataFrame, table: str, batch_id: int, date_from: str | None = None, rebalance: bool = True) -> DataFrame:
        """Write one batch and hand back what was written."""
        stored = df
        if date_from is None and table not in sinks.TABLES:
            stored, date_from = df.withColumn(STAMP, F.lit("1970-01-01").cast("timestamp")), STAMP
        sinks.append_table(stored, self.root, table, batch_id, date_from, rebalance)
        path = f"{sinks.table_path(self.root, table)}/{sinks.BATCH}={batch_id}"
        return df.sparkSession.read.schema(stored.schema).parquet(path).select(*df.columns)

    def _span_us(self) -> int:
        """How far back any stage looks from the watermark."""
        r = self.rules
        spans = [r.anomaly_window_sec, r.anomaly_baseline_sec] if r.anomaly else [0]
        return (max(*spans, r.dedup_window_sec, self.unique_sec or 0) + self.delay_sec) * 1_000_000

    def _marks(self, spark, batch_id: int) -> list[tuple[int, int]]:
        """(batch, newest time) of recent batches: a handful of rows."""
        return [(r.batch, r.max_us) for r in self._snapshot(spark, "recent_batches", MARKS, batch_id).collect()]

    def _logs_since(self, spark, marks: list[tuple[int, int]], since_us: int) -> DataFrame | None:
        """Stored logs of the recent batches that reach this far."""
        paths = [f"{sinks.table_path(self.root, 'logs_staged')}/{sinks.BATCH}={b}" for b, newest in marks if newest >= since_us]
        return spark.read.schema(ROWS).parquet(*paths) if paths else None

    # --- stages -----------------------------------------------------------

    def _chained(self, logs: DataFrame, batch_id: int, watermark: int | None) -> DataFrame:
        if not self.rules.enable_hash_chain:
            return self._write(logs, "chained", batch_id, "timestamp")
        before = self._snapshot(logs.sparkSession, "chain_state", HEADS, batch_id)
        dated = logs.withColumn("chain_date", utc_date(F.col("timestamp")).cast("string"))
        built = integrity.build_hash_chain(dated, CHAIN, ORDER, self.rules.hmac_key, lanes=self.lanes, heads=before)
        # The rows of a chain are together already, and a chain has one day.
        stored = self._write(built, "chained", batch_id, "timestamp", rebalance=False)
        heads = self._write(integrity.chain_heads(stored, CHAIN, ORDER, self.rules.hmac_key), "chain_heads", batch_id)
        both = before.unionByName(heads.select(*HEADS.fieldNames()))
        if watermark is not None:
            # Rows of a day behind the watermark are late: its chains are finished.
            both = both.filter(F.col("chain_date") >= utc_date(F.timestamp_micros(F.lit(watermark))).cast("string"))
        self._write(integrity.last_heads(both, CHAIN), "chain_state", batch_id)
        return stored

    def _detections(self, logs: DataFrame, batch_id: int, marks: list[tuple[int, int]], watermark: int | None) -> DataFrame:
        r, spark = self.rules, logs.sparkSession
        if not (r.ensemble and r.dedup_window_sec > 0):
            found = flow.detections_of(logs, replace(r, anomaly=False), flow.ROW)
        else:
            fired = detect.explode_detections(detect.detect_ensemble(logs, detect.ensemble_rules(r.dynamic_rules)))
            before = self._snapshot(spark, "last_kept", KEPT, batch_id)
            kept = self._write(dedup.dedup_detections(
                fired, r.dedup_window_sec, order_cols=(*flow.ROW, "rule_pos"), state=before), "kept", batch_id, "timestamp")
            after = dedup.dedup_state(kept, before)
            if watermark is not None:
                # A window that ended before the watermark suppresses nothing any more.
                after = after.filter(F.col("last_us") >= watermark - r.dedup_window_sec * 1_000_000)
            self._write(after, "last_kept", batch_id)
            found = detect.threshold_rows(kept, r.aggregator, r.threshold, flow.ROW).drop("aggregate_score")
        if r.anomaly:
            found = found.unionByName(self._anomalies(logs, marks).select(found.columns))
        return found

    def _anomalies(self, logs: DataFrame, marks: list[tuple[int, int]]) -> DataFrame:
        """Counts over this batch and the stored logs a baseline before it."""
        r = self.rules
        seen = [*flow.ROW, "type", "boundary", "timestamp"]
        now = logs.select(*seen, F.lit(True).alias("_new"))
        oldest = logs.agg(F.min(F.unix_micros("timestamp"))).first()[0]
        if oldest is not None:
            since = oldest - max(r.anomaly_window_sec, r.anomaly_baseline_sec) * 1_000_000
            past = self._logs_since(logs.sparkSession, marks, since)
            if past is not None:
                now = now.unionByName(past.filter(F.unix_micros("timestamp") >= since).select(*seen, F.lit(False).alias("_new")))
        rows = anomaly.detect_anomaly(
            now, r.anomaly_window_sec, r.anomaly_baseline_sec, r.anomaly_threshold_pct, r.anomaly_min_baseline,
            order=flow.ROW[0], carry=flow.ROW[1:], emit=F.col("_new"))
        return logs.join(rows.select(*flow.ROW, *DETECTION.fieldNames()), list(flow.ROW))

    def _blocks(self, found: DataFrame, batch_id: int) -> None:
        r = self.rules
        planned = response.expand_strategy(response.extract_target(
            response.match_response_rule(found, r.response_rules, r.default_strategy)))
        marked, pending = response.block_mode(planned, r.block_mode)
        if pending is not None:
            self._write(pending, "pending_blocks", batch_id)
            return
        blocks = self._write(response.block_rows(marked), "blocks", batch_id, "blocked_at")
        if self.blocker:
            self.blocker(blocks)

    # --- one micro-batch --------------------------------------------------

    def __call__(self, raw: DataFrame, batch_id: int) -> None:
        spark, r = raw.sparkSession, self.rules
        marks = self._marks(spark, batch_id)
        watermark = max(m for _, m in marks) - self.delay_sec * 1_000_000 if marks else None
        now, late = split_late(raw, watermark)
        if watermark is not None:
            late = flow.mask(normalize.conform(late), r)
        self._write(late, "late_logs", batch_id)
        ready = flow.prepare(now, r, tell_apart=True)
        self._write(ready.rejected, "rejected_logs", batch_id, "timestamp")
        if ready.denied is not None:
            self._write(ready.denied, "denied_logs", batch_id, "timestamp")
        logs = self._chained(ready.logs, batch_id, watermark).withColumn(sinks.ROW_ID, sinks.row_id(batch_id))
        newest = logs.agg(F.max(F.unix_micros("timestamp"))).first()[0]
        recent = marks if newest is None else [
            m for m in marks if m[1] >= max(newest, *(x for _, x in marks)) - self._span_us() - self.delay_sec * 1_000_000] + [(batch_id, newest)]
        self._write(spark.createDataFrame(recent, MARKS), "recent_batches", batch_id)
        stored = None
        if self.unique_sec is not None:
            reach = (newest or 0) - self.unique_sec * 1_000_000
            stored = self._logs_since(spark, marks, reach)
            stored = spark.createDataFrame([], ROWS) if stored is None else stored
        sinks.append_logs(logs.select(*ROWS.fieldNames()), self.root, batch_id, r.fail_on_persist_error,
                          ("timestamp", "logical_clock", "span_id"), stored=stored)
        if self.on_logs:
            self.on_logs(logs)

        found = self._write(self._detections(logs, batch_id, marks, watermark), "detections", batch_id)
        made = tasks.dispatch_status(tasks.generate_tasks(
            found, r.task_rules, F.col("source_timestamp"), [sinks.ROW_ID], flow.ROW))
        made = self._write(made, "generated", batch_id, "created_at")
        made = tasks.run_handlers(made, self.handlers, self.default_handler)
        made = self._write(approvals.route_approvals(made, r.routing_rules), "assigned", batch_id, "created_at")
        self._write(sinks.task_rows(made), "tasks", batch_id)
        self._write(made.select("task_id", "rule_id", "status", "error", F.col("created_at").alias("dispatched_at")),
                    "task_results", batch_id)
        self._write(approvals.create_approvals(made), "approvals", batch_id)

        if r.response:
            records = self._write(flow.respond(found, r, self.analyzer, [sinks.ROW_ID], flow.ROW), "responded", batch_id, "created_at")
            self._write(response.flat_responses(records), "threat_responses", batch_id)
            sent = self._write(flow.notify(records, r, self.routing, self.channel_types), "outbox", batch_id)
            self._blocks(found, batch_id)
            if self.notifier:
                self.notifier(sent)
        if r.agent:
            runs = self._write(flow.delegate(made, r, self.model), "agent_runs", batch_id, "source_timestamp")
            self._write(agents.agent_task_results(runs), "agent_task_results", batch_id, "dispatched_at")
            if self.feedback:
                # Same batch id, same folder: a replay writes the same logs again.
                agents.own_trace_ids(agents.agent_results_to_logs(runs)).write.mode("overwrite").parquet(
                    f"{self.feedback.rstrip('/')}/{sinks.BATCH}={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start() if trigger else writer.start()


def detect_stream(logs: DataFrame, rules: RuleSet) -> DataFrame:
    """Normalised, masked and scored detections of a stream, without any state.

    Thresholds work on the array of fired rules before it is exploded, so the
    whole stage is narrow.
    """
    ready = flow.prepare(logs, rules)
    fired = detect.detect_ensemble(ready.logs, detect.ensemble_rules(rules.dynamic_rules))
    return detect.explode_detections(detect.apply_threshold(fired, rules.aggregator, rules.threshold))

"""Streaming forms over the given tables: one stream read to its end, then its output.

State and output folders go where the session says checkpoints go.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from logwarden.config import load_rules
from logwarden.operators import approvals, detect, integrity, response
from logwarden.plans import flow
from logwarden.plans.sizing import saved
from logwarden.schemas import LOG_SCHEMA
from logwarden.sources import sinks
from logwarden.streaming import decisions, keyed
from logwarden.streaming.blocks import block_join_stream
from logwarden.streaming.tables import StreamFlow

from .inputs import NORM_CTE, RAW_SQL, SERVICE, norm_logs, raw_logs, scratch, with_nested
from .intake import mask_sql
from .outcomes import BLOCKS_CTE, DECISION_CTE, ROUTED_CTE, _net, decision_df, request_df, routed, task_df
from .registry import query
from .stubs import stub_inference
from .rules import CONF, HMAC_KEY, rules
from .signals import ANOMALY, ANOMALY_CTE, DEDUP_CTE, fired_cte
from logwarden.operators.normalize import normalize, split_valid


#: How late rows of the shuffled streams come at most, and the slots they wait in.
DELAY_SEC, SLOT_SEC = 2 * 86400, 43200
#: The rows of a file of such a stream: a micro-batch has as many files as its rows need.
FILE_ROWS = 100_000
LATER = datetime(2100, 1, 1)
SHUFFLED = {"delay": f"{DELAY_SEC} seconds", "slot_sec": SLOT_SEC, "until": LATER}


def shuffled_stream(spark, rows, tie, clock, time_col="timestamp", n=4):
    """A stream of ``n`` micro-batches whose rows are up to ``DELAY_SEC`` late, and of one with a last clock row.

    Each of them has ``k`` files, as many as its rows need tasks; where rows make fewer, empty files fill up.
    """
    folder = scratch(spark)
    late = F.pmod(F.xxhash64(tie), F.lit(DELAY_SEC * 1_000_000))
    rows.withColumn("_arrival", F.unix_micros(F.col(time_col).cast("timestamp")) + late).write.parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")
    cuts = [None, *stored.approxQuantile("_arrival", [i / n for i in range(1, n)], 0.01), None]
    k = max(1, -(-stored.count() // (n * FILE_ROWS)))
    last = stored.drop("_arrival").limit(1)
    nothing = spark.createDataFrame([], last.schema)

    def put(part, number):
        part = part.coalesce(1) if k == 1 else part.repartition(k)
        part.write.mode("append").parquet(f"{folder}/files")
        for _ in range(number * k - len(spark.read.schema(last.schema).parquet(f"{folder}/files").inputFiles())):
            nothing.coalesce(1).write.mode("append").parquet(f"{folder}/files")

    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = stored.filter((F.lit(True) if lo is None else F.col("_arrival") >= lo) & (F.lit(True) if hi is None else F.col("_arrival") < hi))
        put(part.drop("_arrival"), i + 1)
    put(last.withColumns({c: v.cast(last.schema[c].dataType) for c, v in clock.items()}).coalesce(1), n + 1)
    return spark.readStream.schema(last.schema).option("maxFilesPerTrigger", k).parquet(f"{folder}/files")


def shuffled_logs(spark, sf):
    """Normalised logs of a shuffled stream of events; the clock is an event that any rule and any key takes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKSDB)
    events = spark.read.parquet(f"{sf}/events.parquet")
    clock = {"event_id": F.lit(1_000_000_001), "event_type": F.lit("error"), "value": F.lit(300), "ts": F.lit(LATER)}
    stream = shuffled_stream(spark, events, "event_id", clock, "ts")
    flat = spark.sql(RAW_SQL.replace("FROM events", "FROM {events}"), events=stream)
    return normalize(split_valid(with_nested(flat))[0], SERVICE)


def event_stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKSDB)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def raw_stream(spark, sf):
    flat = spark.sql(RAW_SQL.replace("FROM events", "FROM {events}"), events=event_stream(spark, sf))
    return with_nested(flat)


def drain(spark, stream):
    """Run the stream over everything there is; its output as a table."""
    out = scratch(spark)
    q = (stream.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/out")


@query("dedup_stream", f"""
    WITH RECURSIVE {DEDUP_CTE} SELECT concat(lpad(CAST(event_id AS VARCHAR), 12, '0'), '-', lpad(CAST(rule_pos AS VARCHAR), 3, '0')) AS tie
    FROM walk WHERE kept
""")
def _(spark, sf):
    fired = detect.explode_detections(
        detect.detect_ensemble(shuffled_logs(spark, sf), detect.ensemble_rules(rules().dynamic_rules)))
    tied = fired.withColumn("tie", F.concat(
        F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit("-"), F.lpad(F.col("rule_pos").cast("string"), 3, "0")))
    return drain(spark, keyed.dedup_stream(tied, 21600, **SHUFFLED)).filter(~F.col("late")).select("tie")


@query("anomaly_stream", f"""
    WITH {NORM_CTE}, {ANOMALY_CTE} SELECT trace_id, prio AS priority, round(sc, 6) AS score FROM anomalies
""")
def _(spark, sf):
    found = drain(spark, keyed.anomaly_stream(shuffled_logs(spark, sf), **ANOMALY, **SHUFFLED))
    return found.select(F.col("tie").alias("trace_id"), "priority", F.round("score", 6).alias("score"))


@query("block_stream", f"""
    WITH {BLOCKS_CTE}
    SELECT t.event_id, b.us IS NOT NULL AND t.us - b.us <= 86400000000 * 3 AS is_blocked
    FROM traffic t ASOF LEFT JOIN blocks b ON t.ip = b.ip AND t.us >= b.us WHERE t.ip <> ''
""")
def _(spark, sf):
    logs = shuffled_logs(spark, sf)
    kept = detect.explode_detections(detect.apply_threshold(
        detect.detect_ensemble(logs, detect.ensemble_rules(rules().dynamic_rules))))
    ip = F.col("payload.ip")
    blocks = kept.filter((F.col("payload.kind") == "security_intrusion") & (ip != "0.0.0.0")).select(
        _net(ip).alias("ip"), "timestamp", F.lit(keyed.BLOCK).alias("kind"), F.col("event_id").cast("string").alias("tie"))
    traffic = logs.select(
        F.when(F.size("tags") > 0, _net(F.get("tags.category", F.lit(0)))).otherwise("").alias("ip"), "timestamp",
        F.lit(keyed.TRAFFIC).alias("kind"), F.col("event_id").cast("string").alias("tie"))
    out = drain(spark, keyed.block_stream(blocks.unionByName(traffic), 86400 * 3, **SHUFFLED))
    return out.filter(~F.col("late")).select(F.col("tie").cast("bigint").alias("event_id"), "is_blocked")


LIFTED_SQL = f"""
    WITH {BLOCKS_CTE}, moves AS (SELECT ip, us * 2 AS m FROM blocks UNION ALL SELECT ip, us * 2 + 1 FROM traffic WHERE event_id % 40 = 5),
    latest AS (SELECT t.event_id, max(m) AS m FROM traffic t LEFT JOIN moves b
      ON t.ip = b.ip AND b.m // 2 <= t.us AND t.us - b.m // 2 <= 86400000000 * 3 WHERE t.ip <> '' GROUP BY ALL)
    SELECT event_id, CASE WHEN m % 2 = 0 THEN m // 2 END AS blocked_at_us, coalesce(m % 2 = 0, false) AS is_blocked FROM latest
"""


def traffic_and_moves(logs):
    """Traffic by address, and the blocks and lifts that the logs lead to."""
    address = F.when(F.size("tags") > 0, _net(F.get("tags.category", F.lit(0)))).otherwise("")
    traffic = logs.select(address.alias("ip"), "timestamp", "event_id", F.col("event_id").cast("string").alias("tie"))
    kept = detect.explode_detections(detect.apply_threshold(
        detect.detect_ensemble(logs, detect.ensemble_rules(rules().dynamic_rules))))
    ip = F.col("payload.ip")
    blocks = kept.filter((F.col("payload.kind") == "security_intrusion") & (ip != "0.0.0.0")).select(
        _net(ip).alias("ip"), "timestamp", F.lit(keyed.BLOCK).alias("kind"))
    lifts = traffic.filter("event_id % 40 = 5").select("ip", "timestamp", F.lit(keyed.LIFT).alias("kind"))
    return traffic, blocks, lifts


@query("flag_lifted_traffic", LIFTED_SQL)
def _(spark, sf):
    """The as-of lookup with lifts."""
    traffic, blocks, lifts = traffic_and_moves(norm_logs(spark, sf))
    flagged = response.flag_blocked_traffic(
        traffic.withColumn("event_us", F.unix_micros("timestamp")), blocks.withColumnRenamed("timestamp", "blocked_at"), 86400 * 3,
        carry=("event_id",), lifts=lifts.withColumnRenamed("timestamp", "lifted_at"))
    inside = F.col("event_us") - F.col("blocked_at_us") <= 86400_000_000 * 3
    return flagged.filter("ip <> ''").select("event_id", F.when(inside, F.col("blocked_at_us")).alias("blocked_at_us"), "is_blocked")


@query("block_join_stream", LIFTED_SQL)
def _(spark, sf):
    """The same from two shuffled streams, which meet by address."""
    traffic = traffic_and_moves(shuffled_logs(spark, sf))[0]
    _, blocks, lifts = traffic_and_moves(shuffled_logs(spark, sf))
    delay = f"{DELAY_SEC} seconds"
    out = drain(spark, block_join_stream(traffic, blocks.unionByName(lifts), 86400 * 3, delay, delay, LATER, SLOT_SEC))
    return out.select(F.col("tie").cast("bigint").alias("event_id"), "blocked_at_us", "is_blocked")


@query("stream_flow", f"""
    WITH RECURSIVE {NORM_CTE}, masked AS (SELECT * REPLACE ({mask_sql('message')} AS message) FROM norm),
    {fired_cte(source='masked')},
    o AS (SELECT event_id, rule_pos, us, concat_ws('|', event_name, boundary, service_id) AS k,
          row_number() OVER (PARTITION BY event_name, boundary, service_id ORDER BY us, trace_id, rule_pos) AS rn FROM fired),
    walk AS (
      SELECT event_id, rule_pos, k, rn, us AS last_us, true AS kept FROM o WHERE rn = 1
      UNION ALL
      SELECT o.event_id, o.rule_pos, o.k, o.rn,
        CASE WHEN o.us - w.last_us > 21600 * 1000000::BIGINT THEN o.us ELSE w.last_us END,
        o.us - w.last_us > 21600 * 1000000::BIGINT
      FROM walk w JOIN o ON o.k = w.k AND o.rn = w.rn + 1),
    s AS (SELECT f.trace_id, f.rule_id, max(f.score) OVER (PARTITION BY f.event_id) AS agg
          FROM fired f JOIN walk w ON w.event_id = f.event_id AND w.rule_pos = f.rule_pos AND w.kept)
    SELECT trace_id, rule_id FROM s WHERE agg >= 0.5
""")
def _(spark, sf):
    """The flow as a stream with its state in tables: the detections it stored."""
    r = load_rules({**CONF, "masking_policies": [], "authorization": {}, "response": {},
                    "agent": {}, "ensemble": {**CONF["ensemble"], "dedup_window_sec": 21600}})
    root = scratch(spark)
    raw = raw_stream(spark, sf)
    raw = raw.select(*[c for c in raw.columns if c in LOG_SCHEMA.fieldNames()])
    job = StreamFlow(r, f"{root}/tables", default_handler=lambda d: None, model=stub_inference)
    job.start(raw, f"{root}/state", availableNow=True).awaitTermination()
    return sinks.read_table(spark, f"{root}/tables", "detections").select("trace_id", "rule_id")


@query("audit_sinks", f"""
    WITH {ROUTED_CTE}
    SELECT 'task_results' AS name, count(*)::BIGINT AS n, count(DISTINCT task_id)::BIGINT AS n_ids FROM tasks
    UNION ALL SELECT 'approvals', count(*)::BIGINT, count(DISTINCT approval_id)::BIGINT FROM requests
""")
def _(spark, sf):
    """Two batches, the second one written twice: the tables hold every row once."""
    root = scratch(spark)
    # Six writes follow: the tasks are made once and stored.
    made = saved(task_df(spark, sf))
    req = saved(approvals.create_approvals(approvals.route_approvals(made, rules().routing_rules)))
    half = F.pmod(F.hash("task_id"), F.lit(2))
    results = made.select("task_id", "rule_id", "status", F.lit("").alias("error"), F.col("created_at").alias("dispatched_at"))
    for batch in (0, 1, 1):
        sinks.append_table(results.filter(half == batch), root, "task_results", batch)
        sinks.append_table(req.filter(half == batch), root, "approvals", batch)
    count = lambda t, c: sinks.read_table(spark, root, t).agg(
        F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("n_ids"))
    return count("task_results", "task_id").unionByName(count("approvals", "approval_id"))


_RECORDS = """
    moved AS (SELECT r.*, t.description, CASE WHEN r.event_id % 3 = 0 THEN 'KILL_SWITCH' ELSE t.action_type END AS act,
        CASE WHEN r.event_id % 5 = 0 THEN r.us + 5400000000 END AS change_us FROM requests r JOIN tasks t USING (task_id)),
    seen AS (SELECT d.*, m.total_steps, m.act, coalesce(d.action = 'approved' AND m.change_us <= d.decided_us, false) AS tampered
        FROM decisions d JOIN moved m USING (task_id)),
    effective AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY decided_us, seq) AS step_order FROM seen
        WHERE actor_id <> '' AND NOT tampered),
    counted AS (SELECT *, coalesce(sum((action = 'rejected')::INT) OVER (PARTITION BY task_id ORDER BY step_order
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rej FROM effective),
    taken AS (SELECT *, CASE WHEN action = 'rejected' THEN 'rejected' WHEN step_order = total_steps THEN 'approved' ELSE 'in_review' END AS state
        FROM counted WHERE rej = 0 AND step_order <= total_steps),
    told AS (SELECT *, CASE state WHEN 'rejected' THEN 'rejected' WHEN 'in_review' THEN 'blocked_approval'
        ELSE CASE WHEN act = 'KILL_SWITCH' THEN 'failed' ELSE 'dispatched' END END AS task_status FROM taken),
    ended AS (SELECT task_id, decided_us AS end_us, task_status FROM told WHERE state <> 'in_review')"""


def decision_inputs(spark, sf):
    """Requests, edits of some of their tasks, and decisions, all as moves."""
    made = saved(routed(spark, sf).withColumn("action_type", F.when(F.col("event_id") % 3 == 0, "KILL_SWITCH").otherwise(F.col("action_type"))))
    req = saved(approvals.create_approvals(made, carry=("event_id", *decisions.EDITABLE)))
    edited = made.filter("event_id % 5 = 0 and status = 'blocked_approval'").withColumns({
        "description": F.concat("description", F.lit(" (edited)")), "modified_by": F.lit("editor"),
        "modified_at": F.timestamp_micros(F.unix_micros("created_at") + 5_400_000_000)})
    return req, edited, decision_df(req)


@query("decision_flow", f"""
    WITH {DECISION_CTE.partition("usable AS")[0].rstrip().rstrip(",")}, {_RECORDS}
    SELECT task_id, 'step' AS record, seq, step_order::BIGINT AS step_order, concat(state, ' ', task_status) AS detail,
      CASE WHEN task_status = 'failed' THEN concat('CRITICAL: no handler registered for KILL_SWITCH (task=', task_id, ')') ELSE '' END AS error FROM told
    UNION ALL
    SELECT task_id, 'refused', seq, NULL, '', CASE WHEN actor_id = '' THEN 'task_id and actor_id are required'
        WHEN decided_us > end_us THEN concat('task status is ', task_status, ', expected blocked_approval')
        ELSE 'task content has been tampered with since approval was created' END
      FROM seen LEFT JOIN ended USING (task_id) WHERE actor_id = '' OR tampered OR decided_us > end_us
    UNION ALL
    SELECT task_id, 'modified', 0, NULL, concat('description: ', description, ' -> ', description, ' (edited)'), '' FROM moved WHERE change_us IS NOT NULL
""")
def _(spark, sf):
    """Requests, edits and decisions as one shuffled stream through the state machine of each task."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKSDB)
    req, edited, decided = decision_inputs(spark, sf)
    moves = decisions.request_moves(req).unionByName(decisions.change_moves(edited)).unionByName(decisions.decision_moves(decided))
    stream = shuffled_stream(spark, moves, "task_id", {"timestamp": F.lit(LATER)})
    out = drain(spark, decisions.decision_stream(stream, **SHUFFLED))
    change = F.concat("field", F.lit(": "), "old_value", F.lit(" -> "), "new_value")
    detail = F.when(F.col("record") == "modified", change).when(
        F.col("record") == "step", F.concat_ws(" ", "status", "task_status")).otherwise("")
    return out.select("task_id", "record", "seq", F.col("step_order").cast("bigint").alias("step_order"), detail.alias("detail"), "error")


@query("batch_flow", f"""
    WITH {NORM_CTE}, c AS (SELECT boundary, CAST(CAST(event_ts AS DATE) AS VARCHAR) AS chain_date, count(*)::BIGINT AS n FROM norm GROUP BY ALL)
    SELECT boundary, chain_date, n AS n_rows, 0::BIGINT AS links_broken, 0::BIGINT AS rows_altered, 0::BIGINT AS n_missing, true AS end_ok,
      CASE WHEN n % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS cut_missing, n % 3 <> 0 AS cut_end_ok, 0::BIGINT AS cut_broken FROM c
""")
def _(spark, sf):
    """Three batches that share all days, so that each one brings times before those already chained.

    The chains of the stored logs are verified as they are, and again with the last two
    rows of some chains cut off: no link of the rest is broken, the signed heads tell.
    """
    r = load_rules({**CONF, "masking_policies": [], "authorization": {}, "response": {}, "agent": {}, "ensemble": {}})
    root = f"{scratch(spark)}/tables"
    raw = raw_logs(spark, sf)
    for batch in (2, 0, 1):
        part = raw.filter(F.col("event_id") % 3 == batch)
        flow.run_batch(part.select(*[c for c in part.columns if c in LOG_SCHEMA.fieldNames()]), r, root, batch)
    logs = sinks.read_table(spark, root, "logs")
    heads = sinks.read_table(spark, root, "chain_heads")
    chain, number = list(flow.CHAIN), [integrity.SEQ]

    def reports(rows):
        links = integrity.chain_report(integrity.verify_chain(rows, chain, number, [HMAC_KEY]), chain, number)
        return links, integrity.verify_heads(rows, heads, chain, [HMAC_KEY])

    size = F.max(integrity.SEQ).over(Window.partitionBy(*chain, "chain_lane"))
    cut = logs.withColumn("_n", size).filter((F.col("_n") % 3 != 0) | (F.col(integrity.SEQ) <= F.col("_n") - 2)).drop("_n")
    links, ends = reports(logs)
    cut_links, cut_ends = reports(cut)
    keys = [*chain, "chain_lane"]
    both = links.join(ends.filter("head_ok").drop("n_rows"), keys).join(
        cut_ends.select(*keys, F.col("n_missing").alias("cut_missing"), F.col("end_ok").alias("cut_end_ok")), keys).join(
        cut_links.select(*keys, (F.col("links_broken") + F.col("rows_altered")).alias("cut_broken")), keys)
    return both.select(
        "boundary", "chain_date", "n_rows", "links_broken", "rows_altered", "n_missing", "end_ok", "cut_missing", "cut_end_ok", "cut_broken")


__all__ = ["request_df"]

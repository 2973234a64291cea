"""Tasks, approvals, responses, agents, notifications, lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from logwarden.functions.severity import classify_severity, severity_gte
from logwarden.operators import agents, approvals, detect, integrity, lookups, outbox, response, tasks
from logwarden.plans import flow
from logwarden.sources import sinks

from . import stubs
from .inputs import NORM_CTE, SERVICE, norm_logs, raw_logs, us
from .intake import mask_sql
from .registry import query
from .rules import HMAC_KEY, rules
from .signals import ANOMALY, ANOMALY_CTE, FIRED_CTE, PAYLOAD_FIELDS, _js, ensemble, fired_cte, hmac_sql

SEVERITY_SQL = """CASE WHEN is_critical THEN 'CRITICAL'
  WHEN event_name = 'SECURITY_INTRUSION_DETECTED' THEN CASE WHEN level >= 6 THEN 'CRITICAL' ELSE 'HIGH' END
  WHEN event_name = 'SYSTEM_CRITICAL_FAILURE' THEN CASE WHEN priority = 'HIGH' THEN 'CRITICAL' ELSE 'HIGH' END
  WHEN event_name = 'COMPLIANCE_VIOLATION' THEN 'HIGH' WHEN event_name = 'AI_ACTION_REQUIRED' THEN 'MEDIUM'
  WHEN level >= 6 THEN 'CRITICAL' WHEN level >= 5 THEN 'HIGH' WHEN level >= 4 THEN 'MEDIUM'
  WHEN level >= 3 THEN 'LOW' ELSE 'INFO' END"""


def rank_sql(c: str) -> str:
    return f"CASE {c} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def esc_sql(js: str) -> str:
    for ch, code in (("<", "003c"), (">", "003e"), ("&", "0026")):
        js = f"replace({js}, '{ch}', '\\u{code}')"
    return js


def _rule_values() -> str:
    rows = []
    for r in rules().task_rules:
        p, g = r["exec_params"], r["guardrails"]
        rows.append(
            f"({r['rule_pos']}, '{r['rule_id']}', '{r['event_name']}', '{r['severity']}', '{r['action_type']}', "
            f"'{r['execution_level']}', {r['priority']}, '{r['description']}', '{p['target_endpoint']}', "
            f"'{p['script_identifier']}', '{p['notification_channel']}', '{p['prompt_template']}', "
            f"{str(g['require_human_approval']).lower()}, {g['timeout_ms']}, {g['max_retries']})")
    return ", ".join(rows)


DET_CTE = f"""{FIRED_CTE}, {ANOMALY_CTE},
    det AS (SELECT * EXCLUDE (agg) FROM (SELECT *, max(score) OVER (PARTITION BY event_id) AS agg FROM fired) WHERE agg >= 0.5),
    det_all AS (
      SELECT *, '' AS metric_key FROM det
      UNION ALL BY NAME
      SELECT * EXCLUDE (cw, cb, baseline, deviation_pct, prio, sc), 1000000 AS rule_pos, 'ANOMALY_DETECTED' AS event_name,
        prio AS priority, sc AS score, 'anomaly-frequency' AS rule_id, 'anomaly' AS kind FROM anomalies)"""


def task_cte(det: str = "det") -> str:
    return f"""sev AS (SELECT * EXCLUDE (severity), {SEVERITY_SQL} AS severity FROM {det}),
    trules(rpos, task_rule, r_event, r_severity, action_type, execution_level, prio_no, description, target_endpoint,
      script_identifier, notification_channel, prompt_template, needs_approval, timeout_ms, max_retries) AS (
      VALUES {_rule_values()}),
    tasks AS (
      SELECT event_id, us, event_ts, sha256(concat_ws('|', trace_id, event_name, task_rule, rule_id, CAST(rule_pos AS VARCHAR))) AS task_id,
        task_rule AS rule_id, rule_id AS detection_rule_id, event_name, severity, action_type, execution_level, prio_no AS priority,
        description, target_endpoint, script_identifier, notification_channel, prompt_template, needs_approval,
        timeout_ms, max_retries, trace_id AS source_trace_id, message AS source_message, boundary AS source_boundary,
        level AS source_level, origin, loop_depth, rule_pos AS detection_pos,
        row_number() OVER (PARTITION BY event_id, rule_pos ORDER BY prio_no, rpos) AS task_seq,
        CASE WHEN needs_approval THEN 'blocked_approval' WHEN execution_level IN ('AUTO','SEMI_AUTO') THEN 'dispatched'
             WHEN execution_level = 'MANUAL' THEN 'blocked_approval' ELSE 'skipped' END AS status
      FROM sev JOIN trules ON r_event = event_name AND {rank_sql('severity')} >= {rank_sql('r_severity')})"""


TASK_CTE = f"{DET_CTE}, {task_cte()}"
CONTENT_SQL = esc_sql(f"""concat('{{"action_type":"', action_type, '","description":', {_js('description')}, ',"event_name":"', event_name,
  '","exec_params":{{"TargetEndpoint":"', target_endpoint, '","ScriptIdentifier":"', script_identifier,
  '","NotificationChannel":"', notification_channel, '","PromptTemplate":"', prompt_template,
  '"}},"execution_level":"', execution_level, '","rule_id":"', rule_id, '","severity":"', severity,
  '","source_message":', {_js('source_message')}, ',"source_trace_id":"', source_trace_id, '","task_id":"', task_id, '"}}')""")


def det_rows(spark, sf):
    """Ensemble detections that pass the default threshold."""
    kept = detect.apply_threshold(ensemble(spark, sf))
    return detect.explode_detections(kept).drop("aggregate_score")


def all_rows(spark, sf):
    """The same with frequency anomalies added."""
    r = rules()
    r.anomaly_window_sec, r.anomaly_baseline_sec = ANOMALY["window_sec"], ANOMALY["baseline_sec"]
    r.anomaly_threshold_pct, r.anomaly_min_baseline = ANOMALY["threshold_pct"], ANOMALY["min_baseline"]
    return det_rows(spark, sf).unionByName(flow.anomalies_of(norm_logs(spark, sf), r))


def task_df(spark, sf):
    made = tasks.generate_tasks(det_rows(spark, sf), rules().task_rules, F.col("source_timestamp"), carry=("event_id",))
    return tasks.dispatch_status(made)


# --- severity and tasks ---------------------------------------------------

@query("classify_severity", f"""
    WITH {DET_CTE} SELECT event_id, rule_pos::BIGINT AS rule_pos, {SEVERITY_SQL} AS severity FROM det_all
""")
def _(spark, sf):
    return all_rows(spark, sf).select(
        "event_id", F.col("rule_pos").cast("bigint").alias("rule_pos"),
        classify_severity(F.col("event_name"), F.col("priority"), F.col("level"), F.col("is_critical")).alias("severity"))


@query("severity_gte", f"""
    WITH {NORM_CTE}, s AS (SELECT event_id, CASE level WHEN 6 THEN 'CRITICAL' WHEN 5 THEN 'HIGH' WHEN 4 THEN 'MEDIUM'
      WHEN 3 THEN 'LOW' WHEN 2 THEN 'INFO' ELSE 'odd' END AS a,
      CASE event_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN 'nope' ELSE 'MEDIUM' END AS b FROM norm)
    SELECT event_id, {rank_sql('a')} >= {rank_sql('b')} AS gte FROM s
""")
def _(spark, sf):
    a = (F.when(F.col("level") == 6, "CRITICAL").when(F.col("level") == 5, "HIGH").when(F.col("level") == 4, "MEDIUM")
         .when(F.col("level") == 3, "LOW").when(F.col("level") == 2, "INFO").otherwise("odd"))
    m = F.col("event_id") % 4
    b = F.when(m == 0, "HIGH").when(m == 1, "LOW").when(m == 2, "nope").otherwise("MEDIUM")
    return norm_logs(spark, sf).select("event_id", severity_gte(a, b).alias("gte"))


@query("generate_tasks", f"""
    WITH {TASK_CTE}
    SELECT task_id, rule_id, detection_rule_id, event_name, severity, action_type, execution_level, priority::BIGINT AS priority,
      description, script_identifier, notification_channel, needs_approval, timeout_ms::BIGINT AS timeout_ms, source_trace_id,
      source_message, source_boundary, source_level::BIGINT AS source_level, us AS source_us, task_seq::BIGINT AS task_seq FROM tasks
""")
def _(spark, sf):
    return task_df(spark, sf).select(
        "task_id", "rule_id", "detection_rule_id", "event_name", "severity", "action_type", "execution_level",
        F.col("priority").cast("bigint").alias("priority"), "description", "exec_params.script_identifier",
        "exec_params.notification_channel", F.col("guardrails.require_human_approval").alias("needs_approval"),
        F.col("guardrails.timeout_ms").cast("bigint").alias("timeout_ms"), "source_trace_id", "source_message",
        "source_boundary", F.col("source_level").cast("bigint").alias("source_level"),
        F.unix_micros("source_timestamp").alias("source_us"), F.col("task_seq").cast("bigint").alias("task_seq"))


@query("rule_counts", f"""
    WITH {TASK_CTE} SELECT event_name, count(DISTINCT rule_id)::BIGINT AS n_rules, count(*)::BIGINT AS n_tasks
    FROM tasks GROUP BY ROLLUP (event_name)
""")
def _(spark, sf):
    counts = tasks.rule_counts(rules().frame(spark, "task_rules"))
    made = task_df(spark, sf).rollup("event_name").agg(F.count(F.lit(1)).alias("n_tasks"))
    both = made.alias("m").join(counts.alias("c"), F.col("m.event_name").eqNullSafe(F.col("c.event_name")))
    return both.select("m.event_name", "n_rules", "n_tasks")


@query("dispatch_status", f"WITH {TASK_CTE} SELECT rule_id, status, count(*)::BIGINT AS n FROM tasks GROUP BY ALL")
def _(spark, sf):
    return task_df(spark, sf).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("dispatch_outcome", f"""
    WITH {TASK_CTE}
    SELECT task_id, CASE WHEN status = 'dispatched' AND action_type = 'KILL_SWITCH' THEN 'failed' ELSE status END AS status,
      CASE WHEN status = 'dispatched' AND action_type = 'KILL_SWITCH'
        THEN concat('CRITICAL: no handler registered for KILL_SWITCH (task=', task_id, ')') ELSE '' END AS error FROM tasks
""")
def _(spark, sf):
    return tasks.dispatch_outcome(task_df(spark, sf), ["AUTOMATED_REMEDIATE"]).select("task_id", "status", "error")


@query("tasks_by_rule", f"""
    WITH {NORM_CTE}, masked AS (SELECT * REPLACE ({mask_sql('message')} AS message, {mask_sql('actor_id')} AS actor_id) FROM norm),
    {fired_cte(source='masked')},
    det AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY event_id) AS agg FROM fired) WHERE agg >= 0.5),
    {task_cte()}
    SELECT rule_id, status, severity, count(*)::BIGINT AS n_tasks, count(DISTINCT source_trace_id)::BIGINT AS n_logs,
      count(*) FILTER (contains(source_message, '[MASKED_'))::BIGINT AS n_masked FROM tasks GROUP BY ALL
""")
def _(spark, sf):
    """The flow end to end: raw logs to tasks per rule and status."""
    r = rules()
    r.authorization, r.masking_policies = False, []
    ready = flow.prepare(raw_logs(spark, sf), r)
    made = flow.assign(flow.detections_of(ready.logs, r), r)
    return made.groupBy("rule_id", "status", "severity").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_distinct("source_trace_id").alias("n_logs"),
        F.count_if(F.contains("source_message", F.lit("[MASKED_"))).alias("n_masked"))


# --- approvals ------------------------------------------------------------

ROUTED_CTE = f"""{TASK_CTE}, routed AS (SELECT *,
      CASE WHEN event_name = 'COMPLIANCE_VIOLATION' AND source_level BETWEEN 4 AND 6 THEN 'comp-high'
           WHEN event_name = 'COMPLIANCE_VIOLATION' AND source_level BETWEEN 1 AND 1 THEN 'comp-empty'
           WHEN source_level BETWEEN 1 AND 2 THEN 'any-low' ELSE '' END AS route_rule_id FROM tasks),
    steps AS (SELECT *, CASE route_rule_id WHEN 'comp-high' THEN 3 WHEN 'any-low' THEN 2 WHEN 'comp-empty' THEN 0 ELSE 1 END AS n_steps
      FROM routed),
    requests AS (SELECT event_id, event_ts, task_id, sha256(concat_ws('|', 'approval', task_id)) AS approval_id,
      sha256({CONTENT_SQL}) AS content_hash, greatest(n_steps, 1) AS total_steps, us FROM steps WHERE status = 'blocked_approval')"""

DECISION_CTE = f"""{ROUTED_CTE},
    decisions AS (SELECT task_id, i AS seq, us + i * 3600000000 AS decided_us,
        CASE WHEN (event_id + i) % 7 = 0 THEN '' ELSE concat('person-', i) END AS actor_id,
        CASE WHEN (event_id + i) % 4 = 0 THEN 'rejected' ELSE 'approved' END AS action
      FROM (SELECT *, unnest(range(0, event_id % 6)) AS i FROM requests)),
    usable AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY decided_us, seq) AS step_order
      FROM decisions WHERE actor_id <> ''),
    ranked AS (SELECT u.*, r.approval_id, r.content_hash, r.total_steps,
        coalesce(sum(CASE WHEN action = 'rejected' THEN 1 ELSE 0 END) OVER (PARTITION BY u.task_id ORDER BY step_order
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rej FROM usable u JOIN requests r USING (task_id)),
    accepted AS (SELECT * FROM ranked WHERE rej = 0 AND step_order <= total_steps),
    agg AS (SELECT task_id, count(*) FILTER (action = 'approved') AS ok, bool_or(action = 'rejected') AS no,
      max(decided_us) AS last_us FROM accepted GROUP BY task_id),
    states AS (SELECT r.*, coalesce(ok, 0) AS ok, coalesce(no, false) OR coalesce(ok, 0) >= total_steps AS done, last_us,
      CASE WHEN coalesce(no, false) THEN 'rejected' WHEN coalesce(ok, 0) >= total_steps THEN 'approved'
           WHEN coalesce(ok, 0) > 0 THEN 'in_review' ELSE 'pending' END AS status
      FROM requests r LEFT JOIN agg USING (task_id))"""


STEPS = approvals.longest_chain(rules().routing_rules)


def routed(spark, sf):
    return approvals.route_approvals(task_df(spark, sf), rules().routing_rules)


def request_df(spark, sf):
    return approvals.create_approvals(routed(spark, sf), carry=("event_id",))


def decision_df(requests):
    i = F.col("seq")
    r = requests.select("task_id", "event_id", "requested_at",
                        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("seq"))
    r = r.filter(i < F.col("event_id") % 6)
    return r.select(
        "task_id", "seq",
        F.timestamp_micros(F.unix_micros("requested_at") + i * F.lit(3_600_000_000)).alias("decided_at"),
        F.when((F.col("event_id") + i) % 7 == 0, "").otherwise(F.concat(F.lit("person-"), i.cast("string"))).alias("actor_id"),
        F.lit("lead").alias("actor_role"), F.lit("ok").alias("reason"),
        F.when((F.col("event_id") + i) % 4 == 0, "rejected").otherwise("approved").alias("action"))


@query("route_approvals", f"WITH {ROUTED_CTE} SELECT task_id, route_rule_id, n_steps::BIGINT AS n_steps FROM steps")
def _(spark, sf):
    return routed(spark, sf).select("task_id", "route_rule_id", F.size("chain").cast("bigint").alias("n_steps"))


@query("create_approvals", f"""
    WITH {ROUTED_CTE} SELECT approval_id, task_id, 'pending' AS status, content_hash, 1::BIGINT AS current_step,
      total_steps::BIGINT AS total_steps, us AS requested_us FROM requests
""")
def _(spark, sf):
    return request_df(spark, sf).select(
        "approval_id", "task_id", "status", "content_hash", F.col("current_step").cast("bigint").alias("current_step"),
        F.col("total_steps").cast("bigint").alias("total_steps"), F.unix_micros("requested_at").alias("requested_us"))


@query("task_content_hash", f"WITH {TASK_CTE} SELECT task_id, sha256({CONTENT_SQL}) AS content_hash FROM tasks")
def _(spark, sf):
    return integrity.task_content_hash(task_df(spark, sf)).select("task_id", "content_hash")


@query("apply_approvals", f"""
    WITH {DECISION_CTE} SELECT task_id, status, least(ok + 1, total_steps)::BIGINT AS current_step,
      CASE WHEN done THEN last_us END AS resolved_us FROM states
""")
def _(spark, sf):
    req = request_df(spark, sf)
    states = approvals.apply_approvals(req, approvals.accepted_decisions(req, decision_df(req), STEPS))
    return states.select("task_id", "status", F.col("current_step").cast("bigint").alias("current_step"),
                         F.unix_micros("resolved_at").alias("resolved_us"))


@query("approval_steps", f"""
    WITH {DECISION_CTE} SELECT sha256(concat_ws('|', 'step', approval_id, CAST(step_order AS VARCHAR))) AS record_id, approval_id,
      step_order::BIGINT AS step_order, action, actor_id, decided_us AS created_us FROM accepted
""")
def _(spark, sf):
    req = request_df(spark, sf)
    rec = approvals.step_records(approvals.accepted_decisions(req, decision_df(req), STEPS))
    return rec.select("record_id", "approval_id", F.col("step_order").cast("bigint").alias("step_order"), "action",
                      "actor_id", F.unix_micros("created_at").alias("created_us"))


@query("refused_decisions", f"""
    WITH {DECISION_CTE} SELECT task_id, d.seq, CASE WHEN d.actor_id = '' THEN 'task_id and actor_id are required'
      ELSE concat('approval status is ', s.status) END AS error
    FROM decisions d JOIN states s USING (task_id) WHERE d.actor_id = '' OR (s.done AND d.decided_us > s.last_us)
""")
def _(spark, sf):
    req = request_df(spark, sf)
    dec = decision_df(req)
    states = approvals.apply_approvals(req, approvals.accepted_decisions(req, dec, STEPS))
    return approvals.refused_decisions(dec, states).select("task_id", "seq", "error")


@query("approved_tasks", f"""
    WITH {DECISION_CTE} SELECT t.rule_id, CASE s.status WHEN 'approved' THEN 'dispatched' WHEN 'rejected' THEN 'rejected'
      ELSE t.status END AS status, count(*)::BIGINT AS n FROM tasks t LEFT JOIN states s USING (task_id) GROUP BY ALL
""")
def _(spark, sf):
    made = routed(spark, sf)
    req = approvals.create_approvals(made, carry=("event_id",))
    states = approvals.apply_approvals(req, approvals.accepted_decisions(req, decision_df(req), STEPS))
    return approvals.approved_tasks(made, states, has_default=True).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("check_tampering", f"WITH {ROUTED_CTE} SELECT task_id FROM requests WHERE event_id % 5 = 0")
def _(spark, sf):
    made = routed(spark, sf)
    changed = made.withColumn("description", F.when(F.col("event_id") % 5 == 0, "changed").otherwise(F.col("description")))
    return approvals.check_tampering(approvals.create_approvals(made), changed).select("task_id")


@query("approval_history", f"""
    WITH {DECISION_CTE}, pick AS (SELECT max_by(approval_id, (n, approval_id)) AS id FROM
      (SELECT approval_id, count(*) AS n FROM accepted GROUP BY approval_id))
    SELECT step_order::BIGINT AS step_order, action, actor_id, decided_us AS created_us FROM accepted, pick WHERE approval_id = pick.id
""")
def _(spark, sf):
    """History of the request with the most steps."""
    req = request_df(spark, sf)
    rec = approvals.step_records(approvals.accepted_decisions(req, decision_df(req), STEPS))
    counts = rec.groupBy("approval_id").agg(F.count(F.lit(1)).alias("n"))
    busiest = counts.agg(F.max_by("approval_id", F.struct("n", "approval_id"))).scalar()
    return approvals.approval_history(rec, busiest).select(
        F.col("step_order").cast("bigint").alias("step_order"), "action", "actor_id",
        F.unix_micros("created_at").alias("created_us"))


@query("task_modifications", f"""
    WITH {TASK_CTE}, v AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'LOW' ELSE severity END AS new_severity,
      CASE WHEN event_id % 4 = 0 THEN concat(description, ' (edited)') ELSE description END AS new_description FROM tasks)
    SELECT task_id, 'severity' AS field, severity AS old_value, new_severity AS new_value FROM v WHERE severity <> new_severity
    UNION ALL SELECT task_id, 'description', description, new_description FROM v WHERE description <> new_description
""")
def _(spark, sf):
    old = task_df(spark, sf)
    new = old.withColumns({
        "severity": F.when(F.col("event_id") % 3 == 0, "LOW").otherwise(F.col("severity")),
        "description": F.when(F.col("event_id") % 4 == 0, F.concat("description", F.lit(" (edited)")))
        .otherwise(F.col("description")),
        "editor": F.lit("someone")})
    changes = approvals.derive_modifications(old, new, ["severity", "description", "action_type"], "editor", "created_at")
    return changes.select("task_id", "field", "old_value", "new_value")


@query("current_status", f"""
    WITH {TASK_CTE}, u AS (SELECT task_id, i, CASE i WHEN 0 THEN 'dispatched' WHEN 1 THEN 'failed' ELSE 'completed' END AS s
      FROM (SELECT *, unnest(range(0, event_id % 4)) AS i FROM tasks))
    SELECT t.task_id, coalesce(max_by(u.s, u.i), t.status) AS status, CASE WHEN max_by(u.s, u.i) = 'failed' THEN 'boom' ELSE '' END AS error_message
    FROM tasks t LEFT JOIN u ON u.task_id = t.task_id GROUP BY t.task_id, t.status
""")
def _(spark, sf):
    made = task_df(spark, sf)
    u = made.select("task_id", "event_id", "created_at", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seq"))
    s = F.when(F.col("seq") == 0, "dispatched").when(F.col("seq") == 1, "failed").otherwise("completed")
    updates = u.filter(F.col("seq") < F.col("event_id") % 4).select(
        "task_id", s.alias("status"), F.when(F.col("seq") == 1, "boom").otherwise("").alias("error"),
        F.col("created_at").alias("updated_at"), "seq")
    return approvals.current_status(made, updates).select("task_id", "status", "error_message")


# --- threat response ------------------------------------------------------

_NO_IP = "('', '0.0.0.0')"
RESP_CTE = f"""{DET_CTE},
    strat AS (SELECT *, CASE WHEN event_name = 'SECURITY_INTRUSION_DETECTED' AND priority = 'HIGH' THEN 'BLOCK_AND_NOTIFY'
        WHEN event_name = 'SYSTEM_CRITICAL_FAILURE' AND priority = 'HIGH' THEN 'ANALYZE_AND_NOTIFY'
        WHEN event_name IN ('COMPLIANCE_VIOLATION', 'AI_ACTION_REQUIRED') THEN 'BLOCK_ONLY' ELSE 'NOTIFY_ONLY' END AS strategy,
      CASE event_name WHEN 'COMPLIANCE_VIOLATION' THEN 'lock_account' WHEN 'AI_ACTION_REQUIRED' THEN 'revoke_token' ELSE 'block_ip' END AS action
      FROM det_all),
    tgt AS (SELECT *,
      CASE WHEN coalesce(ip, '') IN {_NO_IP} THEN tag_ip ELSE ip END AS target_ip,
      CASE WHEN kind = 'compliance_violation' THEN user_id ELSE actor_id END AS target_user_id,
      CASE WHEN kind = 'anomaly' THEN concat_ws('|', type, boundary) ELSE '' END AS target_metric,
      CASE WHEN kind = 'compliance_violation' THEN document_id ELSE '' END AS target_resource,
      strategy IN ('BLOCK_AND_NOTIFY', 'ANALYZE_AND_NOTIFY') AS do_analyze,
      strategy IN ('BLOCK_AND_NOTIFY', 'BLOCK_ONLY') AS do_block,
      strategy IN ('BLOCK_AND_NOTIFY', 'ANALYZE_AND_NOTIFY', 'NOTIFY_ONLY') AS do_notify FROM strat),
    blk AS (SELECT *,
      CASE WHEN NOT do_block THEN NULL WHEN action = 'lock_account' THEN target_user_id ELSE target_ip END AS block_target,
      CASE WHEN NOT do_block THEN NULL WHEN action = 'revoke_token' THEN 'no block action registered for type: revoke_token'
        WHEN action = 'block_ip' AND target_ip IN {_NO_IP} THEN 'no valid IP to block'
        WHEN action = 'lock_account' AND target_user_id = '' THEN 'no user ID to lock' ELSE '' END AS block_error FROM tgt),
    resp AS (SELECT *, block_error = '' AS block_ok,
      sha256(concat_ws('|', 'response', trace_id, event_name, rule_id, CAST(rule_pos AS VARCHAR))) AS response_id,
      CASE WHEN do_analyze THEN CASE priority WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' ELSE 'low' END ELSE '' END AS risk_level,
      CASE WHEN do_analyze THEN concat(event_name, ' at ', boundary) ELSE '' END AS summary,
      CASE strategy WHEN 'BLOCK_AND_NOTIFY' THEN '#security' WHEN 'ANALYZE_AND_NOTIFY' THEN 'ops@example.com'
        WHEN 'NOTIFY_ONLY' THEN 'https://hook.example.com' ELSE '' END AS notify_target FROM blk)"""


def planned(spark, sf):
    r = rules()
    df = response.match_response_rule(all_rows(spark, sf), r.response_rules, r.default_strategy)
    return response.expand_strategy(response.extract_target(df))


def record_df(spark, sf):
    return flow.respond(all_rows(spark, sf), rules(), stubs.stub_analysis, carry=("event_id",))


@query("match_response_rule", f"WITH {RESP_CTE} SELECT event_id, rule_pos::BIGINT AS rule_pos, strategy FROM resp")
def _(spark, sf):
    return planned(spark, sf).select("event_id", F.col("rule_pos").cast("bigint").alias("rule_pos"), "strategy")


@query("extract_target", f"""
    WITH {RESP_CTE} SELECT event_id, rule_pos::BIGINT AS rule_pos, target_ip AS ip, target_user_id AS user_id, boundary,
      target_metric AS metric_key, target_resource AS resource_id FROM resp
""")
def _(spark, sf):
    return planned(spark, sf).select("event_id", F.col("rule_pos").cast("bigint").alias("rule_pos"), "target.*")


@query("expand_strategy", f"""
    WITH {RESP_CTE} SELECT event_id, rule_pos::BIGINT AS rule_pos, do_analyze, do_block, do_notify FROM resp
""")
def _(spark, sf):
    return planned(spark, sf).select(
        "event_id", F.col("rule_pos").cast("bigint").alias("rule_pos"), "do_analyze", "do_block", "do_notify")


@query("plan_blocks", f"""
    WITH {RESP_CTE} SELECT event_id, rule_pos::BIGINT AS rule_pos, CASE WHEN do_block THEN action END AS action_type,
      block_target AS target, block_ok AS success, block_error AS error FROM resp
""")
def _(spark, sf):
    b = F.col("block")
    return response.plan_blocks(planned(spark, sf)).select(
        "event_id", F.col("rule_pos").cast("bigint").alias("rule_pos"), b["action_type"].alias("action_type"),
        b["target"].alias("target"), b["success"].alias("success"), b["error"].alias("error"))


PENDING_CTE = f"""{RESP_CTE}, pending AS (
      SELECT event_id, us, sha256(concat_ws('|', 'block', trace_id, event_name, CAST(rule_pos AS VARCHAR))) AS block_id, action,
        target_ip, target_user_id, boundary, event_name AS reason, block_error FROM resp WHERE do_block)"""


def pending_df(spark, sf):
    return response.block_mode(planned(spark, sf), "REQUIRE_APPROVAL")[1]


@query("block_mode", f"""
    WITH {PENDING_CTE} SELECT block_id, action AS action_type, target_ip, target_user_id, boundary, reason, us AS created_us FROM pending
""")
def _(spark, sf):
    return pending_df(spark, sf).select(
        "block_id", "action_type", "target_ip", "target_user_id", "boundary", "reason",
        F.unix_micros("created_at").alias("created_us"))


# Decisions over pending blocks, made up from the hash of the block.
_NIBBLE = "CAST(('0x' || substr(block_id, 1, 2)) AS BIGINT)"
BLOCK_DECISION_CTE = f"""{PENDING_CTE},
    d AS (SELECT block_id, i AS seq, us + i AS at_us, CASE WHEN ({_NIBBLE} + i) % 3 = 0 THEN 'rejected' ELSE 'approved' END AS act,
      concat('op-', i) AS who FROM (SELECT *, unnest(range(0, {_NIBBLE} % 4)) AS i FROM pending)),
    resolved AS (SELECT p.*, min_by(d.act, d.seq) AS act, min_by(d.who, d.seq) AS who, min(d.at_us) AS at_us
      FROM pending p LEFT JOIN d USING (block_id) GROUP BY ALL)"""


def block_decisions(pending):
    n = F.conv(F.substring("block_id", 1, 2), 16, 10).cast("bigint")
    d = pending.select("block_id", "created_at", n.alias("n"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("seq"))
    return d.filter(F.col("seq") < F.col("n") % 4).select(
        "block_id", "seq", F.timestamp_micros(F.unix_micros("created_at") + F.col("seq")).alias("decided_at"),
        F.when((F.col("n") + F.col("seq")) % 3 == 0, "rejected").otherwise("approved").alias("action"),
        F.concat(F.lit("op-"), F.col("seq").cast("string")).alias("actor_id"))


def resolved_df(spark, sf):
    pending = pending_df(spark, sf)
    return response.resolve_blocks(pending, block_decisions(pending))


@query("resolve_blocks", f"""
    WITH {BLOCK_DECISION_CTE} SELECT block_id, coalesce(act, 'pending') AS status, coalesce(who, '') AS resolved_by, at_us AS resolved_us,
      CASE WHEN act = 'approved' THEN block_error = '' END AS success, CASE WHEN act = 'approved' THEN block_error END AS error FROM resolved
""")
def _(spark, sf):
    return resolved_df(spark, sf).select(
        "block_id", "status", "resolved_by", F.unix_micros("resolved_at").alias("resolved_us"),
        F.col("block.success").alias("success"), F.col("block.error").alias("error"))


@query("pending_blocks", f"WITH {BLOCK_DECISION_CTE} SELECT block_id, action AS action_type, us AS created_us FROM resolved WHERE act IS NULL")
def _(spark, sf):
    return lookups.pending_blocks(resolved_df(spark, sf)).select(
        "block_id", "action_type", F.unix_micros("created_at").alias("created_us"))


@query("pending_count", f"WITH {BLOCK_DECISION_CTE} SELECT count(*)::BIGINT AS n_pending FROM resolved WHERE act IS NULL")
def _(spark, sf):
    return response.pending_count(resolved_df(spark, sf))


_NET = r"regexp_replace({}, '\.\d+$', '')"
BLOCKS_CTE = f"""{DET_CTE},
    blocks AS (SELECT {_NET.format('ip')} AS ip, us FROM det WHERE kind = 'security_intrusion' AND ip <> '0.0.0.0'),
    traffic AS (SELECT event_id, {_NET.format('tag_ip')} AS ip, us FROM norm)"""


def _net(c):
    return F.regexp_replace(c, r"\.\d+$", "")


def blocks_df(spark, sf):
    ip = F.col("payload.ip")
    rows = det_rows(spark, sf).filter((F.col("payload.kind") == "security_intrusion") & (ip != "0.0.0.0"))
    return rows.select(_net(ip).alias("ip"), F.col("timestamp").alias("blocked_at"))


@query("active_blocks", f"""
    WITH {BLOCKS_CTE}, b AS (SELECT ip, max(us) AS us FROM blocks WHERE us <= epoch_us(TIMESTAMP '2024-01-20') GROUP BY ip),
    u AS (SELECT ip, max(us) AS us FROM traffic WHERE event_id % 40 = 5 AND us <= epoch_us(TIMESTAMP '2024-01-20') GROUP BY ip)
    SELECT b.ip, b.us AS blocked_us FROM b LEFT JOIN u USING (ip)
    WHERE epoch_us(TIMESTAMP '2024-01-20') - b.us <= 1000000::BIGINT * 864000 AND (u.us IS NULL OR u.us < b.us)
""")
def _(spark, sf):
    unblocks = norm_logs(spark, sf).filter("event_id % 40 = 5").select(
        _net(F.get("tags.category", F.lit(0))).alias("ip"), F.col("timestamp").alias("unblocked_at"))
    as_of = F.lit(datetime(2024, 1, 20)).cast("timestamp")
    live = response.active_blocks(blocks_df(spark, sf), unblocks, as_of, 864000)
    return live.select("ip", F.unix_micros("blocked_at").alias("blocked_us"))


@query("flag_blocked_traffic", f"""
    WITH {BLOCKS_CTE}
    SELECT t.event_id, b.us AS blocked_at_us, b.us IS NOT NULL AND t.us - b.us <= 86400000000 * 3 AS is_blocked
    FROM traffic t ASOF LEFT JOIN blocks b ON t.ip = b.ip AND t.us >= b.us
""")
def _(spark, sf):
    ip = F.when(F.size("tags") > 0, _net(F.get("tags.category", F.lit(0)))).otherwise("")
    traffic = us(norm_logs(spark, sf), out="event_us").withColumn("ip", ip)
    flagged = response.flag_blocked_traffic(traffic, blocks_df(spark, sf), 86400 * 3, carry=("event_id",))
    return flagged.select("event_id", "blocked_at_us", "is_blocked")


FLAT_SQL = """response_id, event_id, trace_id, event_name, strategy, target_ip, target_user_id, boundary,
      CASE WHEN do_block THEN action ELSE '' END AS block_action, coalesce(block_ok, false) AS block_success,
      coalesce(block_target, '') AS block_target, do_analyze AS analyzed, risk_level,
      CASE WHEN NOT do_analyze THEN 0.0 WHEN risk_level = 'high' THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence,
      summary AS analysis_summary, do_notify AS notified, notify_target, us AS created_us"""


@query("threat_responses", f"WITH {RESP_CTE} SELECT {FLAT_SQL} FROM resp")
def _(spark, sf):
    flat = response.flat_responses(record_df(spark, sf), ("event_id",))
    return flat.withColumn("created_us", F.unix_micros("created_at")).drop("created_at", "rule_pos")


@query("analyze")
def _(spark, sf):
    """A user function that fails on some rows: the error stays in the row."""
    def picky(prompt, context):
        if context["level"] == 5:
            raise ValueError("no answer")
        return stubs.stub_analysis(prompt, context)

    out = response.analyze(planned(spark, sf), picky)
    return out.select("event_id", "rule_pos", "analysis.summary", "analysis.risk_level", "analysis.error")


@query("ingestion_result", f"""
    WITH {RESP_CTE}, {task_cte('det_all')},
    t AS (SELECT event_id, string_agg(concat(task_id, ':', rule_id, ':', status), ',' ORDER BY detection_pos, task_seq) AS task_text
      FROM tasks GROUP BY event_id),
    r AS (SELECT event_id, string_agg(concat(response_id, ':', strategy, ':', coalesce(block_ok, false), ':', risk_level), ','
      ORDER BY rule_pos, response_id) AS threat_text FROM resp GROUP BY event_id)
    SELECT norm.trace_id, true AS hash_chain_valid, true AS masked, false AS degraded,
      coalesce(task_text, '') AS task_text, coalesce(threat_text, '') AS threat_text
    FROM norm LEFT JOIN t USING (event_id) LEFT JOIN r USING (event_id)
""")
def _(spark, sf):
    found = all_rows(spark, sf)
    made = tasks.dispatch_status(tasks.generate_tasks(found, rules().task_rules, carry=("trace_id",)))
    summaries = response.response_summary(flow.respond(found, rules(), stubs.stub_analysis))
    out = tasks.ingestion_result(norm_logs(spark, sf), made, summaries, True, True)
    return out.select(
        "trace_id", "hash_chain_valid", "masked", "degraded",
        F.array_join(F.transform("tasks_generated", lambda t: F.concat_ws(":", t["task_id"], t["rule_id"], t["status"])), ",")
        .alias("task_text"),
        F.array_join(F.transform("threat_responses", lambda t: F.concat_ws(
            ":", t["response_id"], t["strategy"], t["blocked"].cast("string"), t["risk_level"])), ",").alias("threat_text"))


# --- agents ---------------------------------------------------------------

AGENT_CTE = f"""{TASK_CTE}, chosen AS (SELECT *, CASE WHEN origin = 'AI_AGENT' THEN loop_depth ELSE 0 END AS depth FROM tasks
      WHERE status = 'dispatched' AND action_type IN ('AI_ANALYZE', 'KILL_SWITCH') AND {rank_sql('severity')} >= 3),
    runs AS (SELECT *, depth >= 5 AS deep, CASE severity WHEN 'CRITICAL' THEN 0.95 ELSE 0.85 END AS confidence FROM chosen)"""


def run_df(spark, sf):
    chosen = agents.delegate_tasks(task_df(spark, sf), ["AI_ANALYZE", "KILL_SWITCH"], "HIGH")
    return agents.infer(agents.loop_guard(chosen, 5), stubs.stub_inference, "stub")


@query("delegate_tasks", f"WITH {AGENT_CTE} SELECT task_id FROM chosen")
def _(spark, sf):
    return agents.delegate_tasks(task_df(spark, sf), ["AI_ANALYZE", "KILL_SWITCH"], "HIGH").select("task_id")


@query("loop_guard", f"""
    WITH {AGENT_CTE} SELECT task_id, CASE WHEN deep THEN depth ELSE depth + 1 END::BIGINT AS loop_depth,
      CASE WHEN deep THEN 'failed' ELSE 'ready' END AS agent_status,
      CASE WHEN deep THEN concat('loop depth limit reached (', depth, '/5)') ELSE '' END AS agent_error FROM runs
""")
def _(spark, sf):
    chosen = agents.delegate_tasks(task_df(spark, sf), ["AI_ANALYZE", "KILL_SWITCH"], "HIGH")
    return agents.loop_guard(chosen, 5).select(
        "task_id", F.col("loop_depth").cast("bigint").alias("loop_depth"), "agent_status", "agent_error")


@query("infer")
def _(spark, sf):
    return run_df(spark, sf).select("task_id", "agent_status", "agent_error", "loop_depth", "input_hash",
                                    "inference.action", "inference.confidence", "inference.model")


@query("agent_results_to_logs", f"""
    WITH {AGENT_CTE} SELECT source_trace_id AS trace_id, sha256(concat_ws('|', 'span', task_id)) AS span_id, 'AI_AGENT' AS origin,
      3::BIGINT AS level, 'AI Agent Result: success' AS message, 'agent:stub' AS boundary, (depth + 1)::BIGINT AS loop_depth,
      concat('action=', lower(action_type), ' confidence=', CASE severity WHEN 'CRITICAL' THEN '0.95' ELSE '0.85' END) AS result
    FROM runs WHERE NOT deep
""")
def _(spark, sf):
    logs = agents.agent_results_to_logs(run_df(spark, sf))
    return logs.select("trace_id", "span_id", "origin", F.col("level").cast("bigint").alias("level"), "message", "boundary",
                       F.col("ai_context.loop_depth").cast("bigint").alias("loop_depth"),
                       F.col("agent_back_log")[0]["result"].alias("result"))


@query("agent_task_results", f"""
    WITH {AGENT_CTE} SELECT task_id, rule_id, CASE WHEN deep THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN deep THEN concat('loop depth limit reached (', depth, '/5)') ELSE '' END AS error FROM runs
""")
def _(spark, sf):
    return agents.agent_task_results(run_df(spark, sf)).select("task_id", "rule_id", "status", "error")


# --- notifications --------------------------------------------------------

TYPES = ("webhook", "slack", "gmail", "log")
ROUTING = {"#": ["slack", "pager"], "#sec": ["log"], "https://": ["webhook"], "@": ["gmail"]}
_HOW = """CASE WHEN starts_with(channel, '#sec') THEN ['slack', 'log'] WHEN starts_with(channel, '#') THEN ['slack']
        WHEN starts_with(channel, 'https://') THEN ['webhook'] WHEN starts_with(channel, '@') THEN ['gmail']
        ELSE ['webhook', 'slack', 'gmail', 'log'] END"""
_STATUS = "CASE WHEN do_block THEN CASE WHEN block_ok THEN 'blocked' ELSE concat('failed: ', block_error) END END"
_PAIRS = [
    ("analysis", "CASE WHEN do_analyze THEN summary END"), ("block_action", "CASE WHEN do_block THEN action END"),
    ("block_status", _STATUS), ("response_id", "response_id"), ("risk_level", "CASE WHEN do_analyze THEN risk_level END"),
    ("strategy", "strategy"), ("target_ip", "nullif(target_ip, '')"), ("target_user", "nullif(target_user_id, '')"),
]


def _fields_sql(shape: str, sep: str = ",") -> str:
    """Present fields in key order; ``shape`` is SQL over k and v."""
    return f"concat_ws('{sep}', " + ", ".join(
        f"CASE WHEN ({v}) IS NOT NULL THEN {shape.replace('k!', k).replace('v!', f'({v})')} END" for k, v in _PAIRS) + ")"


NOTE_CTE = f"""{RESP_CTE},
    note AS (SELECT *, notify_target AS channel, concat('Logwarden: ', event_name) AS subject, concat('Strategy: ', strategy) AS body,
      CASE WHEN coalesce(block_ok, false) THEN 'critical' WHEN risk_level <> '' THEN risk_level ELSE 'medium' END AS sev,
      strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') AS at_text FROM resp WHERE do_notify),
    routed AS (SELECT *, unnest({_HOW}) AS channel_type FROM note)"""


def note_df(spark, sf):
    return outbox.notification_rows(record_df(spark, sf), rules().brand, ("event_id",))


@query("notification_rows", f"""
    WITH {NOTE_CTE} SELECT response_id, event_id, channel, subject, body, sev AS severity,
      {_fields_sql("concat('k!=', v!)", ';')} AS fields_text FROM note
""")
def _(spark, sf):
    text = F.array_join(F.transform(F.array_sort(F.map_entries("fields")),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return note_df(spark, sf).select("response_id", "event_id", "channel", "subject", "body", "severity",
                                     text.alias("fields_text"))


@query("route_notifications", f"WITH {NOTE_CTE} SELECT response_id, channel_type FROM routed")
def _(spark, sf):
    return outbox.route_notifications(note_df(spark, sf), ROUTING, TYPES).select("response_id", "channel_type")


@query("broadcast_notifications", f"""
    WITH {NOTE_CTE} SELECT response_id, unnest(['webhook', 'slack', 'gmail', 'log']) AS channel_type FROM note
""")
def _(spark, sf):
    return outbox.broadcast_notifications(note_df(spark, sf), TYPES).select("response_id", "channel_type")


@query("reroute_failed", f"""
    WITH {NOTE_CTE}, lost AS (SELECT response_id FROM routed GROUP BY response_id
      HAVING NOT bool_or(NOT (channel_type = 'slack' OR (channel_type = 'log' AND event_id % 2 = 0))))
    SELECT response_id, unnest(['webhook', 'slack', 'gmail', 'log']) AS channel_type FROM lost
""")
def _(spark, sf):
    notes = note_df(spark, sf)
    sent = outbox.route_notifications(notes, ROUTING, TYPES)
    lost = (F.col("channel_type") == "slack") | ((F.col("channel_type") == "log") & (F.col("event_id") % 2 == 0))
    deliveries = sent.select("response_id", (~lost).alias("delivered"))
    return outbox.reroute_failed(notes, deliveries, types=TYPES).select("response_id", "channel_type")


_COLOUR = "CASE sev WHEN 'critical' THEN {} WHEN 'high' THEN {} WHEN 'medium' THEN {} WHEN 'low' THEN {} ELSE {} END"
_HEX = _COLOUR.format("'#FF0000'", "'#FF6600'", "'#FFCC00'", "'#36A64F'", "'#439FE0'")
_INT = _COLOUR.format(0xFF0000, 0xFF6600, 0xFFCC00, 0x36A64F, 0x439FE0)
_SHORT = "CASE WHEN octet_length(encode(v!)) < 40 THEN 'true' ELSE 'false' END"
RENDER_SQL = f"""CASE channel_type
    WHEN 'webhook' THEN {esc_sql(f'''concat('{{"body":', {_js('body')}, ',"channel":', {_js('channel')}, ',"event_name":', {_js('event_name')},
      ',"fields":{{', {_fields_sql("concat('\"k!\":', CAST(to_json(v!) AS VARCHAR))")}, '}},"severity":', {_js('sev')}, ',"subject":', {_js('subject')},
      ',"timestamp":"', at_text, '","trace_id":', {_js('trace_id')}, '}}')''')}
    WHEN 'slack' THEN {esc_sql(f'''concat('{{"attachments":[{{"color":"', {_HEX}, '","fields":[',
      {_fields_sql(f"concat('{{\"short\":', {_SHORT}, ',\"title\":\"k!\",\"value\":', CAST(to_json(v!) AS VARCHAR), '}}')")},
      '],"footer":"Logwarden Security Monitor","text":', {_js('body')}, ',"title":', {_js('subject')}, ',"ts":', us // 1000000,
      '}}],"channel":', {_js('channel')}, ',"icon_emoji":":shield:","username":"Logwarden"}}')''')}
    WHEN 'discord' THEN {esc_sql(f'''concat('{{"embeds":[{{"color":', {_INT}, ',"description":', {_js('body')}, ',"fields":[',
      {_fields_sql(f"concat('{{\"inline\":', {_SHORT}, ',\"name\":\"k!\",\"value\":', CAST(to_json(v!) AS VARCHAR), '}}')")},
      '],"footer":{{"text":"Logwarden Security Monitor"}},"timestamp":"', at_text, '","title":', {_js('subject')}, '}}],"username":"Logwarden"}}')''')}
    WHEN 'gmail' THEN concat('From: bot@example.com', chr(13), chr(10), 'To: ',
      CASE WHEN contains(channel, '@') THEN channel ELSE 'a@example.com, b@example.com' END, chr(13), chr(10), 'Subject: ', subject,
      chr(13), chr(10), 'MIME-Version: 1.0', chr(13), chr(10), 'Content-Type: text/plain; charset="UTF-8"', chr(13), chr(10), chr(13), chr(10),
      body, chr(10), chr(10), '--- Details ---', chr(10), {_fields_sql("concat('k!: ', v!, chr(10))", '')}, chr(10), 'Trace ID: ', trace_id, chr(10))
    ELSE concat('[NOTIFY:', event_name, '] ', subject, ' | ', body, ' | severity=', sev, ' traceId=', trace_id) END"""


@query("render_payload", f"""
    WITH {NOTE_CTE}, every AS (SELECT *, unnest(['webhook', 'slack', 'discord', 'gmail', 'log']) AS channel_type FROM note),
    p AS (SELECT response_id, channel_type, {RENDER_SQL} AS payload_text FROM every)
    SELECT *, CASE WHEN channel_type = 'webhook' THEN {hmac_sql('payload_text')} ELSE '' END AS signature FROM p
""")
def _(spark, sf):
    every = outbox.broadcast_notifications(note_df(spark, sf))
    out = outbox.render_payload(every, rules().brand, "bot@example.com", ["a@example.com", "b@example.com"], HMAC_KEY)
    return out.select("response_id", "channel_type", "payload_text", "signature")


_NOTICE = esc_sql(f"""concat('{{"task_id":"', task_id, '","rule_id":"', rule_id, '","event_name":"', event_name, '","severity":"', severity,
  '","action_type":"', action_type, '","description":', {_js('description')}, ',"requested_at":"', strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ'),
  '","source_log":{{"trace_id":', {_js('source_trace_id')}, ',"message":', {_js('source_message')}, ',"boundary":', {_js('source_boundary')}, '}}}}')""")


@query("approval_notices", f"""
    WITH {ROUTED_CTE}, n AS (SELECT task_id, {_NOTICE} AS payload_text FROM steps WHERE status = 'blocked_approval')
    SELECT *, {hmac_sql('payload_text')} AS signature FROM n
""")
def _(spark, sf):
    made = routed(spark, sf)
    return outbox.approval_notices(approvals.create_approvals(made), made, HMAC_KEY).select(
        "task_id", "payload_text", "signature")


# --- stored forms and lookups ---------------------------------------------

@query("append_tasks", f"""
    WITH {TASK_CTE} SELECT task_id, rule_id, status, concat('{{"TargetEndpoint":"', target_endpoint, '","ScriptIdentifier":"', script_identifier,
      '","NotificationChannel":"', notification_channel, '","PromptTemplate":"', prompt_template, '"}}') AS exec_params_json,
      concat('{{"RequireHumanApproval":', needs_approval, ',"TimeoutMs":', timeout_ms, ',"MaxRetries":', max_retries, '}}') AS guardrails_json,
      source_trace_id, us AS source_us FROM tasks
""")
def _(spark, sf):
    return sinks.task_rows(task_df(spark, sf)).select(
        "task_id", "rule_id", "status", "exec_params_json", "guardrails_json", "source_trace_id",
        F.unix_micros("source_timestamp").alias("source_us"))


@query("log_by_trace", f"WITH {NORM_CTE} SELECT event_id, trace_id, message FROM norm WHERE trace_id = 'ev-501'")
def _(spark, sf):
    return lookups.log_by_trace(norm_logs(spark, sf), "ev-501").select("event_id", "trace_id", "message")


@query("task_by_id", f"""
    WITH {TASK_CTE} SELECT task_id, rule_id, status FROM tasks WHERE task_id = (SELECT min(task_id) FROM tasks)
""")
def _(spark, sf):
    made = task_df(spark, sf)
    return lookups.task_by_id(made, made.agg(F.min("task_id")).scalar()).select("task_id", "rule_id", "status")


@query("approval_by_task", f"""
    WITH {ROUTED_CTE} SELECT task_id, approval_id FROM requests WHERE task_id = (SELECT max(task_id) FROM requests)
""")
def _(spark, sf):
    req = request_df(spark, sf)
    return lookups.approval_by_task(req, req.agg(F.max("task_id")).scalar()).select("task_id", "approval_id")


@query("block_by_id", f"WITH {PENDING_CTE} SELECT block_id, reason FROM pending WHERE block_id = (SELECT min(block_id) FROM pending)")
def _(spark, sf):
    pending = pending_df(spark, sf)
    return lookups.block_by_id(pending, pending.agg(F.min("block_id")).scalar()).select("block_id", "reason")


@query("list_tasks", f"""
    WITH {TASK_CTE}, f AS (SELECT * FROM tasks WHERE event_name = 'SYSTEM_CRITICAL_FAILURE' AND status = 'dispatched'
      AND event_ts >= TIMESTAMP '2024-01-05' AND event_ts <= TIMESTAMP '2024-01-25')
    SELECT task_id, rule_id, us AS created_us, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY us DESC, task_id LIMIT 20 OFFSET 10
""")
def _(spark, sf):
    page = lookups.list_tasks(task_df(spark, sf), "SYSTEM_CRITICAL_FAILURE", "dispatched", datetime(2024, 1, 5),
                              datetime(2024, 1, 25), limit=20, offset=10)
    return page.select("task_id", "rule_id", F.unix_micros("created_at").alias("created_us"), "total")


@query("threat_responses_by_trace", f"""
    WITH {RESP_CTE}, pick AS (SELECT max_by(trace_id, (n, trace_id)) AS id FROM (SELECT trace_id, count(*) AS n FROM resp GROUP BY trace_id))
    SELECT response_id, event_name, strategy FROM resp, pick WHERE trace_id = pick.id
""")
def _(spark, sf):
    rec = flow.respond(all_rows(spark, sf), rules())
    counts = rec.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    busiest = counts.agg(F.max_by("trace_id", F.struct("n", "trace_id"))).scalar()
    return lookups.threat_responses_by_trace(rec, busiest).select("response_id", "event_name", "strategy")


__all__ = ["PAYLOAD_FIELDS", "SERVICE"]

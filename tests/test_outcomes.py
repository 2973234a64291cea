import random
import tempfile
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import at, logs, norm
from logwarden.config import load_rules, response_rule_rows, routing_rule_rows, task_rule_rows
from logwarden.operators import agents, approvals, detect, lookups, outbox, response, tasks
from logwarden.plans import flow
from logwarden.sources import logs as sources
from logwarden.sources import sinks
from parity import stubs
from parity.rules import CONF

NOW = None


def found(spark, *rows):
    return detect.detect_first(norm(spark, *rows))


def rule(rid, event="SYSTEM_CRITICAL_FAILURE", **kw):
    return {"rule_id": rid, "event_name": event, "severity": "HIGH", "action_type": "SYSTEM_NOTIFICATION",
            "execution_level": "AUTO", "priority": 1, **kw}


# --- tasks ----------------------------------------------------------------

def test_task_order_and_severity_filter(spark):
    rules = task_rule_rows([rule("late", priority=3), rule("first", severity="LOW"), rule("second", severity="odd"),
                            rule("never", event="X"), rule("crit", severity="CRITICAL", priority=2)])
    df = found(spark, dict(trace_id="c", is_critical=True), dict(trace_id="s", type="SLA", level=4))
    got = {}
    for r in tasks.generate_tasks(df, rules, NOW).orderBy("task_seq").collect():
        got.setdefault(r.source_trace_id, []).append((r.rule_id, r.severity))
    assert [x[0] for x in got["c"]] == ["first", "second", "crit", "late"] and got["c"][0][1] == "CRITICAL"
    assert [x[0] for x in got["s"]] == ["first", "second", "late"] and got["s"][0][1] == "HIGH"
    assert tasks.generate_tasks(df, [], NOW).count() == 0
    frame = load_rules({"flow": {"service_id": "s", "rules": [rule("a"), rule("b", event="X")]}}).frame(spark, "task_rules")
    assert {r.event_name: r.n_rules for r in tasks.rule_counts(frame).collect()} == {"SYSTEM_CRITICAL_FAILURE": 1, "X": 1, None: 2}


def test_dispatch_and_handlers(spark):
    rules = task_rule_rows([
        rule("auto"), rule("semi", execution_level="SEMI_AUTO", action_type="KILL_SWITCH"), rule("man", execution_level="MANUAL"),
        rule("mon", execution_level="MONITOR"), rule("odd", execution_level="?"), rule("esc", action_type="ESCALATE"),
        rule("guard", guardrails={"require_human_approval": True})])
    made = tasks.dispatch_status(tasks.generate_tasks(found(spark, dict(is_critical=True)), rules, NOW))
    assert {r.rule_id: r.status for r in made.collect()} == {
        "auto": "dispatched", "semi": "dispatched", "man": "blocked_approval", "mon": "skipped", "odd": "skipped",
        "esc": "dispatched", "guard": "blocked_approval"}
    out = {r.rule_id: (r.status, r.error) for r in tasks.dispatch_outcome(made).collect()}
    assert out["semi"][0] == "failed" and out["semi"][1].startswith("CRITICAL: no handler registered for KILL_SWITCH")
    seen = []

    def boom(df):
        raise ValueError("nope")
    run = tasks.run_handlers(made, {"SYSTEM_NOTIFICATION": [lambda d: seen.append(d.count())], "ESCALATE": [boom]})
    out = {r.rule_id: (r.status, r.error) for r in run.collect()}
    assert seen == [1] and out["esc"] == ("failed", "handler error: nope") and out["auto"] == ("dispatched", "")


# --- approvals ------------------------------------------------------------

ROUTES = routing_rule_rows([
    {"rule_id": "wild", "min_level": 1, "max_level": 6, "chain": [{"step_order": 1, "role": "a", "required": True}] * 2},
    {"rule_id": "event", "min_level": 5, "max_level": 6, "event_name": "COMPLIANCE_VIOLATION", "chain": []}])


def blocked(spark, n=1, level=5):
    rules = task_rule_rows([rule("r", event="COMPLIANCE_VIOLATION", execution_level="MANUAL", exec_params={"prompt_template": "p"})])
    df = found(spark, *[dict(trace_id=f"t{i:03d}", type="COMPLIANCE", level=level, message="violation") for i in range(n)])
    return tasks.dispatch_status(tasks.generate_tasks(df, rules, NOW))


def test_routing(spark):
    pick = lambda level, rules: approvals.route_approvals(blocked(spark, level=level), rules).first()
    assert (pick(5, ROUTES).route_rule_id, len(pick(5, ROUTES).chain)) == ("event", 0)
    assert (pick(2, ROUTES).route_rule_id, len(pick(2, ROUTES).chain)) == ("wild", 2)
    assert (pick(2, []).route_rule_id, pick(2, []).chain[0].role) == ("", "approver")
    req = approvals.create_approvals(approvals.route_approvals(blocked(spark), ROUTES)).first()
    assert (req.total_steps, req.current_step, req.status) == (1, 1, "pending")


def test_decisions_equal_a_simulation(spark):
    """Random decisions against a step-by-step walk; one task has most of them."""
    rng = random.Random(4)
    req = approvals.create_approvals(approvals.route_approvals(blocked(spark, 30, level=2), ROUTES)).withColumn(
        "total_steps", (F.pmod(F.hash("task_id"), F.lit(4)) + 1).cast("int"))
    req = spark.createDataFrame(req.collect(), req.schema)
    ids = [(r.task_id, r.total_steps) for r in req.collect()]
    dec, want = [], {}
    for n, (tid, total) in enumerate(ids):
        status, ok, end = "pending", 0, None
        for seq in range(rng.randrange(7) if n else 400):
            action, actor = rng.choice(["approved", "approved", "rejected", "comment"]), rng.choice(["x", "y", ""])
            when = at(rng.randrange(3))
            dec.append((tid, actor, "role", action, "why", when, seq))
        for d in sorted([d for d in dec if d[0] == tid], key=lambda d: (d[5], d[6])):
            if d[1] == "" or d[3] not in ("approved", "rejected") or end:
                continue
            if d[3] == "rejected":
                status, end = "rejected", (d[5], d[6])
            else:
                ok += 1
                status, end = ("approved", (d[5], d[6])) if ok == total else ("in_review", None)
        want[tid] = (status, min(ok + 1, total), end[0] if end else None)
    dec.append(("unknown", "x", "role", "approved", "why", at(0), 0))
    df = spark.createDataFrame(dec, "task_id string, actor_id string, actor_role string, action string, reason string, decided_at timestamp, seq long")
    acc = approvals.accepted_decisions(req, df)
    states = approvals.apply_approvals(req, acc)
    assert {r.task_id: (r.status, r.current_step, r.resolved_at) for r in states.collect()} == want
    refused = approvals.refused_decisions(df, states)
    assert acc.count() + refused.count() == len(dec)
    assert refused.filter("task_id = 'unknown'").first().error == "approval request not found"
    done = approvals.approved_tasks(blocked(spark, 30, level=2), states)
    assert done.filter("status = 'dispatched'").count() == sum(w[0] == "approved" for w in want.values())
    one = approvals.step_records(acc)
    aid = one.first().approval_id
    steps = [r.step_order for r in approvals.approval_history(one, aid).collect()]
    assert steps == sorted(steps)


def test_tampering_and_modifications(spark):
    made = approvals.route_approvals(blocked(spark), ROUTES)
    req = approvals.create_approvals(made)
    assert approvals.check_tampering(req, made).count() == 0
    changed = made.withColumn("exec_params", F.col("exec_params").withField("prompt_template", F.lit("other")))
    assert approvals.check_tampering(req, changed).count() == 1
    new = made.withColumn("description", F.lit("d2")).withColumn("who", F.lit("me"))
    mods = approvals.derive_modifications(made, new, ["description", "severity"], "who", "created_at")
    row = approvals.task_modifications(mods, made.first().task_id).first()
    assert (row.field, row.old_value, row.new_value, row.modified_by) == ("description", "", "d2", "me")


# --- response -------------------------------------------------------------

def test_response_rules(spark):
    rules = response_rule_rows([
        {"event_name": "SYSTEM_CRITICAL_FAILURE", "strategy": "BLOCK_ONLY", "min_priority": "HIGH"},
        {"event_name": "SYSTEM_CRITICAL_FAILURE", "strategy": "MONITOR", "min_priority": "MEDIUM"},
        {"event_name": "", "strategy": "ANALYZE_AND_NOTIFY", "min_priority": "HIGH"}])
    df = found(spark, dict(trace_id="hi", is_critical=True), dict(trace_id="med", type="SLA", level=4),
               dict(trace_id="other", type="SECURITY", level=5))
    pick = lambda rs: {r.trace_id: r.strategy for r in response.match_response_rule(df, rs, "NOTIFY_ONLY").collect()}
    assert pick(rules) == {"hi": "BLOCK_ONLY", "med": "MONITOR", "other": "ANALYZE_AND_NOTIFY"}
    assert pick(rules[:1]) == {"hi": "BLOCK_ONLY", "med": "NOTIFY_ONLY", "other": "NOTIFY_ONLY"}
    assert set(pick([]).values()) == {"NOTIFY_ONLY"}


def test_blocks(spark):
    rules = response_rule_rows([{"event_name": "SECURITY_INTRUSION_DETECTED", "strategy": "BLOCK_AND_NOTIFY"},
                                {"event_name": "COMPLIANCE_VIOLATION", "strategy": "BLOCK_ONLY", "block_action": "lock_account"},
                                {"event_name": "SYSTEM_CRITICAL_FAILURE", "strategy": "BLOCK_ONLY", "block_action": "unplug"}])
    df = found(spark, dict(trace_id="ip", type="SECURITY", level=5, tags=[("ip", "10.0.0.1")]),
               dict(trace_id="noip", type="SECURITY", level=5), dict(trace_id="user", type="COMPLIANCE", message="violation"),
               dict(trace_id="odd", is_critical=True))
    df = response.expand_strategy(response.extract_target(response.match_response_rule(df, rules, "MONITOR")))
    got = {r.trace_id: tuple(r.block) for r in response.plan_blocks(df).collect()}
    assert got == {"ip": ("block_ip", "10.0.0.1", True, ""), "noip": ("block_ip", "", False, "no valid IP to block"),
                   "user": ("lock_account", "system", True, ""),
                   "odd": ("unplug", "", False, "no block action registered for type: unplug")}
    assert response.plan_blocks(df, ["unplug"]).filter("trace_id = 'odd'").first().block.success
    waiting, pending = response.block_mode(df, "REQUIRE_APPROVAL")
    assert {r.block.error for r in waiting.collect()} == {"awaiting approval"} and pending.count() == 4
    with pytest.raises(ValueError):
        response.block_mode(df, "LATER")
    ids = {r.target_ip + r.action_type: r.block_id for r in pending.collect()}
    dec = spark.createDataFrame([(ids["10.0.0.1block_ip"], "approved", "me", at(2), 1), (ids["10.0.0.1block_ip"], "rejected", "you", at(3), 2),
                                 (ids["block_ip"], "rejected", "me", at(1), 3)],
                                "block_id string, action string, actor_id string, decided_at timestamp, seq long")
    out = {r.block_id: r for r in response.resolve_blocks(pending, dec).collect()}
    assert out[ids["10.0.0.1block_ip"]].status == "approved" and out[ids["10.0.0.1block_ip"]].block.success
    assert out[ids["block_ip"]].status == "rejected" and out[ids["block_ip"]].block is None
    assert response.pending_count(response.resolve_blocks(pending, dec)).first().n_pending == 2


@pytest.mark.parametrize("ttl, slice_sec", [(0, 50), (60, 10), (60, 1000), (5, 3600)])
def test_blocked_traffic_equals_a_scan(spark, ttl, slice_sec):
    rng = random.Random(ttl + slice_sec)
    blocks = [(rng.choice("ab"), at(rng.randrange(500))) for _ in range(12)]
    traffic = [(rng.choice(["a", "a", "b", "c", ""]), at(rng.randrange(600)), str(i)) for i in range(200)]
    b = spark.createDataFrame(blocks, "ip string, blocked_at timestamp")
    t = spark.createDataFrame(traffic, "ip string, ts timestamp, trace_id string").withColumn("event_us", F.unix_micros("ts"))
    got = {r.trace_id: r.is_blocked for r in response.flag_blocked_traffic(t, b, ttl, slice_sec=slice_sec).collect()}
    want = {}
    for ip, ts, tid in traffic:
        past = [x for i, x in blocks if i == ip and x <= ts]
        want[tid] = bool(past) and (ttl == 0 or ts - max(past) <= timedelta(seconds=ttl))
    assert got == want
    live = response.active_blocks(b, None, F.lit(at(600)).cast("timestamp"), ttl)
    assert {r.ip for r in live.collect()} == {i for i in "ab" if any(x == i and (
        ttl == 0 or at(600) - max(y for j, y in blocks if j == i) <= timedelta(seconds=ttl)) for x, _ in blocks)}


# --- agents ---------------------------------------------------------------

def test_agents(spark):
    rules = task_rule_rows([rule("ai", action_type="AI_ANALYZE"), rule("no")])
    df = found(spark, *[dict(trace_id=f"d{d}", is_critical=True, ai_context=("a", "t", d, "m", 0.1, "")) for d in (0, 4, 5)],
               dict(trace_id="bad", is_critical=True, message="fail"), dict(trace_id="low", type="SLA", level=4))
    made = tasks.dispatch_status(tasks.generate_tasks(df, rules, NOW))
    chosen = agents.delegate_tasks(made, min_severity="CRITICAL")
    assert {r.source_trace_id for r in chosen.collect()} == {"d0", "d4", "d5", "bad"}

    def model(task):
        if task["source_message"] == "fail":
            raise RuntimeError("down")
        return stubs.stub_inference(task)
    runs = agents.infer(agents.loop_guard(chosen), model, "prov")
    got = {r.source_trace_id: r for r in runs.collect()}
    assert (got["d4"].agent_status, got["d4"].loop_depth) == ("success", 5)
    assert (got["d5"].agent_status, got["d5"].agent_error, got["d5"].loop_depth) == ("failed", "loop depth limit reached (5/5)", 5)
    assert (got["bad"].agent_status, got["bad"].agent_error) == ("failed", "down") and len(got["bad"].input_hash) == 32
    new = {r.trace_id: r for r in agents.agent_results_to_logs(runs).collect()}
    assert set(new) == {"d0", "d4", "bad"} and new["bad"].level == 5 and new["bad"].agent_back_log[0].result == "error: down"
    assert new["d4"].ai_context.loop_depth == 5 and new["d4"].boundary == "agent:prov" and new["d4"].level == 3
    assert {r.status for r in agents.agent_task_results(runs).collect()} == {"completed", "failed"}


# --- notifications and lookups --------------------------------------------

def test_notifications(spark):
    rules = load_rules({"flow": {"service_id": "s"}, "response": {"enabled": True, "rules": [
        {"event_name": "", "strategy": "ANALYZE_AND_NOTIFY", "notify_targets": ["#ops"]}]}})
    notes = outbox.notification_rows(flow.respond(found(spark, dict(is_critical=True)), rules, lambda p, c: {"risk_level": "low"}))
    n = notes.first()
    assert (n.severity, n.subject, n.fields["strategy"]) == ("low", "Logwarden: SYSTEM_CRITICAL_FAILURE", "ANALYZE_AND_NOTIFY")
    sent = outbox.route_notifications(notes, flow.DEFAULT_ROUTING, ("slack", "log"))
    assert [r.channel_type for r in sent.collect()] == ["slack"]
    lost = outbox.reroute_failed(notes, sent.select("response_id", F.lit(False).alias("delivered")), types=("slack", "log"))
    assert {r.channel_type for r in lost.collect()} == {"slack", "log"}
    mail = outbox.render_payload(notes.withColumn("channel_type", F.lit("gmail"))).first()
    assert mail.error == "no recipients"


def test_list_tasks_limit_default(spark):
    df = spark.createDataFrame([(f"t{i}", "E", "s", at(i)) for i in range(120)], "task_id string, event_name string, status string, created_at timestamp")
    page = lookups.list_tasks(df, "E", limit=0, start=at(10), end=at(100)).collect()
    assert len(page) == 50 and page[0].task_id == "t100" and {r.total for r in page} == {91}
    assert lookups.list_tasks(df, "none").count() == 0


# --- sinks and the whole batch --------------------------------------------

def test_json_round_trip(spark):
    df = norm(spark, dict(tags=[("a", "b")], resource_ids=["r"], details={"k": "v"}, ai_context=("a", "t", 1, "m", 0.5, "r"),
                          agent_back_log=[("a", "x", at(0.000001), "r", "s")]), dict(tags=None))
    back = sources.decode_log_json(sources.encode_log_json(df)).select(df.columns)
    assert back.collect() == df.collect()


def test_append_logs_unique_and_repeatable(spark):
    root = tempfile.mkdtemp(prefix="lw-sink-")
    rows = [dict(trace_id="a"), dict(trace_id="a", timestamp=at(1)), dict(trace_id="b"), dict(trace_id="b"), dict(trace_id="c")]
    for _ in range(2):
        marked = sinks.append_logs(logs(spark, *rows), root, 0)
        assert sorted((r.trace_id, r.degraded) for r in marked.collect()) == [
            ("a", False), ("a", True), ("b", False), ("b", True), ("c", False)]
    again = sinks.append_logs(logs(spark, dict(trace_id="c"), dict(trace_id="d")), root, 1, lookback_days=3)
    assert {r.trace_id: r.degraded for r in again.collect()} == {"c": True, "d": False}
    assert sorted(r.trace_id for r in sinks.read_table(spark, root, "logs").collect()) == ["a", "b", "c", "d"]
    with pytest.raises(RuntimeError):
        sinks.append_logs(logs(spark, dict(trace_id="a")), root, 2, strict=True)


def test_id_index_reads_the_files_that_may_hit(spark):
    from logwarden.sources import id_index

    path = tempfile.mkdtemp(prefix="lw-index-") + "/t"
    ids = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("id-"), F.col("id").cast("string")).alias("k"))
    assert id_index.known_ids(ids(0, 5), path, 0, "k").collect() == []
    for batch in range(4):
        id_index.write_index(ids(batch * 5000, (batch + 1) * 5000), path, batch, "k", 16)
    id_index.write_index(ids(15_000, 20_000), path, 3, "k", 16)  # written again
    asked = ids(7000, 7003).unionByName(ids(90_000, 95_000)).unionByName(ids(7001, 7002)).unionByName(spark.sql("select cast(null as string) as k"))
    found = id_index.known_ids(asked, path, 9, "k", 16)
    assert sorted(r.k for r in found.collect()) == ["id-7000", "id-7001", "id-7002"]
    files = [f for f in found.inputFiles() if "_ids/" in f]
    assert 1 <= len(files) <= 4 and any("batch_id=1/" in f for f in files)  # of 64
    assert id_index.known_ids(ids(15_000, 15_010), path, 3, "k", 16).count() == 0  # its own batch does not count
    assert id_index.known_ids(ids(0, 20_000), path, 9, "k", 16).count() == 20_000


def test_batches_without_an_index_are_read(spark):
    import shutil

    root = tempfile.mkdtemp(prefix="lw-old-")
    for batch in range(2):
        sinks.append_logs(logs(spark, dict(trace_id=f"a{batch}"), dict(trace_id=f"b{batch}")), root, batch)
    shutil.rmtree(f"{root}/logs_filters/batch_id=0")
    marked = sinks.append_logs(logs(spark, dict(trace_id="a0"), dict(trace_id="a1"), dict(trace_id="c")), root, 2)
    assert {r.trace_id: r.degraded for r in marked.collect()} == {"a0": True, "a1": True, "c": False}


def test_run_batch(spark, sf):
    from parity.inputs import raw_logs
    from logwarden.schemas import LOG_SCHEMA

    rules = load_rules({**CONF, "authorization": {}, "security": {**CONF["security"], "verify_masking": True}, "response": {**CONF["response"], "block_mode": "REQUIRE_APPROVAL"}})
    raw = raw_logs(spark, sf)
    raw = raw.select(*[c for c in raw.columns if c in LOG_SCHEMA.fieldNames()])
    root = tempfile.mkdtemp(prefix="lw-batch-")
    result = flow.run_batch(raw, rules, root, 7, analyzer=stubs.stub_analysis, model=stubs.stub_inference)
    n = sinks.read_table(spark, root, "logs").count()
    assert result.count() == n == flow.prepare(raw, rules).logs.count()
    rows = result.select(F.sum(F.size("tasks_generated")).alias("t"), F.sum(F.size("threat_responses")).alias("r")).first()
    assert rows.t == sinks.read_table(spark, root, "tasks").count() > 0
    assert rows.r == sinks.read_table(spark, root, "threat_responses").count() > 0
    assert sinks.read_table(spark, root, "pending_blocks").count() > 0 and sinks.read_table(spark, root, "outbox").count() > 0
    assert sinks.read_table(spark, root, "logs").filter(F.contains("message", F.lit("4111-1111"))).count() == 0


def test_run_batch_without_findings(spark):
    root = tempfile.mkdtemp(prefix="lw-quiet-")
    raw = logs(spark, *[{"message": f"all is well {i}", "trace_id": f"t{i}"} for i in range(5)])
    rules = load_rules({**CONF, "authorization": {}, "agent": {"enabled": False}})
    result = flow.run_batch(raw, rules, root, 1, analyzer=stubs.stub_analysis)
    assert result.count() == 5 == sinks.read_table(spark, root, "logs").count()


def test_run_batch_with_a_shared_trace(spark):
    """Many logs of one trace: each has its own anomaly, threshold, tasks, responses and result."""
    conf = {**CONF, "authorization": {}, "agent": {"enabled": False},
            "ensemble": {**CONF["ensemble"], "enabled": True, "dedup_window_sec": 1, "aggregator": "weighted_sum"},
            "anomaly": {"enabled": True, "window_size_sec": 60, "baseline_window_sec": 600, "threshold_pct": 100.0,
                        "min_baseline": 0.1}}
    rows = [dict(trace_id="t", message=f"step {i}", is_critical=i % 10 == 0, timestamp=at(7 * (i // 2))) for i in range(40)]
    root = tempfile.mkdtemp(prefix="lw-shared-")
    rules = load_rules(conf)
    result = flow.run_batch(logs(spark, *rows), rules, root, 1, analyzer=stubs.stub_analysis).collect()
    assert len(result) == 40 == len({r.row_id for r in result}) and {r.trace_id for r in result} == {"t"}
    assert sum(not r.degraded for r in result) == 1 == sinks.read_table(spark, root, "logs").count()
    found = sinks.read_table(spark, root, "detections").groupBy("row_id", "rule_id", "rule_pos").count().collect()
    assert {r["count"] for r in found} == {1} and sum(r.rule_id == "anomaly-frequency" for r in found) == 40
    made = sinks.read_table(spark, root, "tasks").select("task_id").collect()
    listed = [t.task_id for r in result for t in r.tasks_generated]
    assert len(made) == len({t.task_id for t in made}) > 0 and sorted(listed) == sorted(t.task_id for t in made)
    answers = [t.response_id for r in result for t in r.threat_responses]
    assert len(answers) == len(set(answers)) == len(found)


def test_identical_logs_without_ids_are_all_stored(spark):
    """A repeated attempt replaces the rows and makes the same ids."""
    root, rules = tempfile.mkdtemp(prefix="lw-same-"), load_rules({**CONF, "authorization": {}, "agent": {"enabled": False}})
    raw = logs(spark, *[dict(trace_id=None, message="again")] * 5)
    ids = []
    for _ in range(2):
        result = flow.run_batch(raw, rules, root, 1, analyzer=stubs.stub_analysis).collect()
        assert len({r.trace_id for r in result}) == 5 and not any(r.degraded for r in result)
        ids.append(sorted((r.trace_id, r.row_id) for r in result))
    assert ids[0] == ids[1] and sinks.read_table(spark, root, "logs").count() == 5


def test_agents_need_a_model(spark):
    rules = load_rules({**CONF, "authorization": {}, "agent": {"enabled": True}})
    with pytest.raises(ValueError, match="model"):
        flow.run_batch(logs(spark, {"message": "x"}), rules, "/nowhere", 1)


def test_times_do_not_follow_the_session_zone(spark):
    from logwarden.functions.text import rfc3339, rfc3339_nano, utc_date

    before = spark.conf.get("spark.sql.session.timeZone")
    out = []
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (1700000000500000, 1699163999000001, 0, -1, 1720000000000000)])).alias("us"))
            ts = F.timestamp_micros("us")
            out.append([tuple(r) for r in df.select(rfc3339(ts), rfc3339_nano(ts), utc_date(ts).cast("string")).collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert out[0] == out[1] == out[2]
    assert out[0][0] == ("2023-11-14T22:13:20Z", "2023-11-14T22:13:20.5Z", "2023-11-14")
    assert out[0][3][2] == "1969-12-31"


def test_lifted_blocks_do_not_flag(spark):
    us = 1_700_000_000_000_000
    hour = 3_600_000_000
    seen = spark.createDataFrame([(f"t{k}", "10.0.0.1", us + k * hour) for k in range(6)], "trace_id string, ip string, event_us bigint")
    blocks = spark.createDataFrame([("10.0.0.1", us + hour), ("10.0.0.1", us + 4 * hour)], "ip string, at bigint").select("ip", F.timestamp_micros("at").alias("blocked_at"))
    lifts = spark.createDataFrame([("10.0.0.1", us + 3 * hour)], "ip string, at bigint").select("ip", F.timestamp_micros("at").alias("lifted_at"))
    rows = response.flag_blocked_traffic(seen, blocks, lifts=lifts).collect()
    assert {r.trace_id: r.is_blocked for r in rows} == {"t0": False, "t1": True, "t2": True, "t3": False, "t4": True, "t5": True}
    without = response.flag_blocked_traffic(seen, blocks).collect()
    assert sum(r.is_blocked for r in without) == 5

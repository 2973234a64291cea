import hashlib
import hmac
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpers import at, counts_by_scan, kept_by_walk, log, norm
from logwarden.config import DynamicRule, dynamic_rule, load_rules
from logwarden.operators import access, anomaly, dedup, detect, integrity
from logwarden.schemas import LOG_SCHEMA

KEY, OLD = b"k" * 32, b"o" * 32
CHAIN, ORDER = ["service_id", "boundary"], ["timestamp", "trace_id"]


def chain_rows(n, boundaries=("a",)):
    return [dict(trace_id=f"t{i:04d}", timestamp=at(i), boundary=boundaries[i % len(boundaries)], message=f"m{i} <&>")
            for i in range(n)]


# --- chains ---------------------------------------------------------------

def test_chain_by_hand_and_one_global_chain(spark):
    df = norm(spark, *chain_rows(20, ("a", "b")))
    built = integrity.build_hash_chain(df, ["service_id"], ORDER, KEY)
    rows = integrity.canonical_json(built).orderBy("timestamp").collect()
    prev = ""
    for r in rows:
        assert r.previous_hash == prev and f'"PreviousHash":"{prev}"' in r.canonical
        prev = hmac.new(KEY, (r.canonical + prev).encode(), hashlib.sha256).hexdigest()
        assert r.hash == prev
    assert '"Message":"m0 \\u003c\\u0026\\u003e"' in rows[0].canonical
    keys = [p.split('"')[1] for p in rows[0].canonical.strip("{}").split(",") if p.startswith('"') and '":' in p]
    assert keys == sorted(keys)


def test_hot_chain_is_split_into_lanes(spark):
    df = norm(spark, *chain_rows(200, ("hot",) * 9 + ("cold",)))
    built = integrity.build_hash_chain(df, CHAIN, ORDER, KEY, target_rows=50)
    lanes = {(r.boundary, r.chain_lane): r.n for r in built.groupBy("boundary", "chain_lane").agg(F.count("*").alias("n")).collect()}
    assert sum(lanes.values()) == 200 and [k for k in lanes if k[0] == "cold"] == [("cold", 0)]
    assert len([k for k in lanes if k[0] == "hot"]) == 4
    ok = integrity.verify_chain(built, CHAIN, ORDER, [KEY])
    assert ok.filter("link_ok AND hash_ok").count() == 200


@pytest.mark.parametrize("damage, links, altered", [
    (lambda d: d.withColumn("message", F.when(F.col("trace_id") == "t0003", "x").otherwise(F.col("message"))), 0, 1),
    (lambda d: d.filter("trace_id <> 't0003'"), 1, 1),
    (lambda d: d.withColumn("timestamp", F.when(F.col("trace_id") == "t0003", F.lit(at(4.5))).otherwise(F.col("timestamp"))), 3, 3),
    (lambda d: d.withColumn("hash", F.when(F.col("trace_id") == "t0003", "").otherwise(F.col("hash"))), 1, 2),
])
def test_damage_is_found(spark, damage, links, altered):
    built = integrity.build_hash_chain(norm(spark, *chain_rows(10)), CHAIN, ORDER, KEY)
    report = integrity.chain_report(integrity.verify_chain(damage(built), CHAIN, ORDER, [KEY]), CHAIN, ORDER).first()
    assert (report.links_broken, report.rows_altered) == (links, altered)
    assert report.first_broken.trace_id in ("t0003", "t0004")


def test_cut_off_end_shows_in_heads(spark):
    built = integrity.build_hash_chain(norm(spark, *chain_rows(10)), CHAIN, ORDER, KEY)
    whole = integrity.chain_heads(built, CHAIN, ORDER, KEY).first()
    cut = integrity.chain_heads(built.filter("trace_id < 't0008'"), CHAIN, ORDER, KEY).first()
    assert whole.n_rows == 10 and (cut.head_hash, cut.head_signature) != (whole.head_hash, whole.head_signature)


def test_chain_continues_from_heads(spark):
    df = norm(spark, *chain_rows(30, ("a", "b")))
    whole = integrity.build_hash_chain(df, CHAIN, ORDER, KEY, lanes=3)
    first = integrity.build_hash_chain(df.filter("trace_id < 't0013'"), CHAIN, ORDER, KEY, lanes=3)
    rest = integrity.build_hash_chain(df.filter("trace_id >= 't0013'"), CHAIN, ORDER, KEY, lanes=3,
                                      heads=integrity.chain_heads(first, CHAIN, ORDER, KEY))
    pairs = lambda d: {tuple(r) for r in d.select("trace_id", "previous_hash", "hash").collect()}
    assert pairs(whole) == pairs(first) | pairs(rest)


def test_chains_count_on_over_batches_in_any_order_of_time(spark):
    df = norm(spark, *chain_rows(30, ("a", "b")))
    parts = [df.filter(F.pmod(F.crc32("trace_id"), F.lit(3)) == i) for i in (2, 0, 1)]
    heads, built, stored = None, [], []
    for part in parts:  # each batch has times before and after those of the others
        rows = integrity.build_hash_chain(part, CHAIN, ORDER, KEY, heads=heads).cache()
        built.append(rows)
        stored.append(integrity.chain_heads(rows, CHAIN, ORDER, KEY))
        heads = integrity.last_heads(reduce(DataFrame.unionByName, stored), CHAIN)
    logs, heads = reduce(DataFrame.unionByName, built), reduce(DataFrame.unionByName, stored)
    number = [integrity.SEQ]

    def broken(rows):
        r = integrity.chain_report(integrity.verify_chain(rows, CHAIN, number, [KEY]), CHAIN, number)
        return r.agg(F.sum("links_broken"), F.sum("rows_altered")).first()

    assert tuple(broken(logs)) == (0, 0)
    assert sorted(r.chain_seq for r in logs.filter("boundary = 'a'").collect()) == list(range(1, 16))
    whole = integrity.verify_heads(logs, heads, CHAIN, [OLD, KEY]).collect()
    assert [(r.n_rows, r.n_missing, r.end_ok, r.head_ok) for r in whole] == [(15, 0, True, True)] * 2
    cut = logs.filter("boundary = 'b' or chain_seq <= 13")
    assert tuple(broken(cut)) == (0, 0)
    ends = {r.boundary: (r.n_rows, r.n_missing, r.end_ok) for r in integrity.verify_heads(cut, heads, CHAIN, [KEY]).collect()}
    assert ends == {"a": (13, 2, False), "b": (15, 0, True)}
    gone = {r.boundary: (r.n_rows, r.n_missing, r.end_ok) for r in integrity.verify_heads(logs.filter("boundary = 'b'"), heads, CHAIN, [KEY]).collect()}
    assert gone["a"] == (0, 15, False)
    forged = integrity.verify_heads(cut, integrity.chain_heads(cut, CHAIN, ORDER, OLD), CHAIN, [KEY])
    assert not forged.filter("head_ok").count()
    inner = logs.filter("boundary <> 'a' or chain_seq <> 5")
    assert tuple(broken(inner)) == (1, 1)
    renumbered = logs.withColumn("chain_seq", F.when(F.col("chain_seq") > 9, F.col("chain_seq") + 1).otherwise(F.col("chain_seq")))
    assert tuple(broken(renumbered)) == (2, 0)


def test_rotation_and_keyless(spark):
    built = integrity.build_hash_chain(norm(spark, *chain_rows(5)), CHAIN, ORDER, OLD)
    index = lambda keys: {r.key_index for r in integrity.verify_chain(built, CHAIN, ORDER, keys).collect()}
    assert index([KEY]) == {None} and index([KEY, OLD]) == {1} and index([OLD]) == {0}
    plain = integrity.build_sha_chain(norm(spark, *chain_rows(5)), CHAIN, ORDER)
    assert integrity.verify_chain(plain, CHAIN, ORDER, None).filter("hash_ok AND link_ok").count() == 5
    with pytest.raises(RuntimeError):
        integrity.build_hash_chain(plain, CHAIN, ORDER, b"short")


# --- rules ----------------------------------------------------------------

def test_fixed_rules_and_agent_skip(spark):
    df = norm(
        spark, dict(trace_id="crit", is_critical=True, level=6),
        dict(trace_id="sec", type="SECURITY", level=5, tags=[("ip", "192.168.1.100")]),
        dict(trace_id="comp", type="COMPLIANCE", message="Data retention policy VIOLATION", actor_id="user-123", resource_ids=["doc-456"]),
        dict(trace_id="sla", type="SLA", level=4), dict(trace_id="quiet"),
        dict(trace_id="agent", type="SECURITY", level=5, origin="AI_AGENT"),
        dict(trace_id="agent-crit", origin="AI_AGENT", is_critical=True))
    got = {r.trace_id: r for r in detect.detect_first(df).collect()}
    assert set(got) == {"crit", "sec", "comp", "sla", "agent-crit"}
    assert got["sec"].payload.ip == "192.168.1.100" and got["sec"].payload.severity == 5
    assert (got["comp"].payload.rule_ref, got["comp"].payload.document_id, got["comp"].payload.user_id) == (
        "AUTO-DETECT-001", "doc-456", "user-123")
    assert got["sla"].priority == "MEDIUM" and got["sla"].payload.error_details.startswith("SLA violation: ")
    assert all(r.score == 0 and r.rule_id == "" for r in got.values())


def test_custom_rules(spark):
    def loud(c):
        return F.when(c("message").contains("!"), detect.detection(
            "LOUD", "LOW", detect.payload("system_critical", component="boundary")))
    df = norm(spark, dict(trace_id="a", message="hey!"), dict(trace_id="b"))
    assert [r.event_name for r in detect.detect_first(df, [loud]).collect()] == ["LOUD"]
    wrapped = detect.wrap_rule(loud, "loud-1", 0.4)
    assert detect.detect_first(df, [wrapped]).first().score == 0.4
    row = detect.explode_detections(detect.detect_ensemble(df, [loud, wrapped])).collect()
    assert [(r.rule_id, r.score, r.rule_pos) for r in row] == [("loud-1", 0.4, 1)]


def test_dynamic_rule_conditions(spark):
    df = norm(spark, dict(trace_id="hit", type="SECURITY", level=4, message="Brute  FORCE", tags=[("a", "1"), ("b", "2")]),
              dict(trace_id="level", type="SECURITY", level=3, message="brute force", tags=[("a", "1"), ("b", "2")]),
              dict(trace_id="tag", type="SECURITY", level=4, message="brute force", tags=[("a", "1")]),
              dict(trace_id="type", type="INFRA", level=4, message="brute force", tags=[("a", "1"), ("b", "2")]))
    rule = DynamicRule("r", "E", "odd", 0.0, "nope", ("SECURITY", "SLA"), ("SYSTEM",), 4, 5, r"(?i)brute\s+force", False, ("a", "b"))
    out = detect.dynamic_rules(df, [rule]).collect()
    assert [(r.trace_id, r.priority, r.score, r.payload.kind) for r in out] == [("hit", "MEDIUM", 1.0, "system_critical")]
    with pytest.raises(RuntimeError):
        dynamic_rule({"rule_id": "x", "event_name": "E", "message_pattern": "("})


def test_scores_threshold_and_top(spark):
    df = norm(spark, dict(trace_id="two", type="SLA", level=4, is_critical=True), dict(trace_id="weak", type="DEBUG"))
    weak = DynamicRule("weak", "E", "HIGH", 0.3, log_types=("DEBUG",))
    fired = detect.detect_ensemble(df, detect.ensemble_rules([weak]))
    s = {r.trace_id: r for r in fired.select("trace_id", *[detect.aggregate_score(F.col("detections"), m).alias(m) for m in (
        "max", "avg", "weighted_sum", "first")]).collect()}
    assert (s["two"]["max"], round(s["two"].avg, 6), s["two"].weighted_sum, s["two"]["first"]) == (1.0, 0.85, 1.0, 1.0)
    assert {r.trace_id for r in detect.apply_threshold(fired, "max", 0).collect()} == {"two"}
    kept = detect.explode_detections(detect.apply_threshold(fired, "avg", 0.85))
    assert sorted(r.rule_id for r in kept.collect()) == ["builtin-critical", "builtin-sla"]
    assert {r.rule_id for r in detect.top_detection(fired).collect()} == {"builtin-critical", "weak"}


# --- repeats --------------------------------------------------------------

def detection_df(spark, rows):
    """rows: (key, second, tie)"""
    return spark.createDataFrame([(k, at(s), t, 0.9, "r") for k, s, t in rows],
                                 "event_name string, timestamp timestamp, tie int, score double, rule_id string").withColumns(
        {"boundary": F.lit("b"), "service_id": F.lit("s"), "trace_id": F.col("tie").cast("string"), "rule_pos": F.lit(0)})


def run_dedup(spark, rows, window, **kw):
    out = dedup.dedup_detections(detection_df(spark, rows), window, order_cols=("tie",), **kw)
    return {r.tie for r in out.collect()}


def test_dedup_anchor_and_closed_end(spark):
    rows = [("a", 0, 1), ("a", 6, 2), ("a", 10, 3), ("a", 10.000001, 4), ("a", 12, 5), ("b", 1, 6), ("a", 0, 7)]
    assert run_dedup(spark, rows, 10) == {1, 4, 6}
    assert run_dedup(spark, rows, 0) == {1, 2, 3, 4, 5, 6, 7}


@pytest.mark.parametrize("seed, window, slice_sec", [(1, 7, 10), (2, 50, 10), (3, 3, 100), (4, 400, 7), (5, 1, 1)])
def test_dedup_slices_equal_a_walk(spark, seed, window, slice_sec):
    """One hot key among others, slices narrower and wider than the window."""
    rng = random.Random(seed)
    rows = [(rng.choice("aaaaaabc"), rng.choice([rng.uniform(0, 600), rng.randrange(600)]), i) for i in range(700)]
    want = {t for _, _, t in kept_by_walk([(k, round(s, 6), t) for k, s, t in rows], window)}
    assert run_dedup(spark, [(k, round(s, 6), t) for k, s, t in rows], window, slice_sec=slice_sec) == want


@pytest.mark.parametrize("seed, window, slice_sec, hot", [(1, 7, 10, 0), (2, 50, 10, 150), (3, 3, 100, 0), (4, 400, 7, 0), (5, 11, 5, 400)])
def test_busy_keys_by_pointer_doubling_equal_a_walk(spark, seed, window, slice_sec, hot):
    """All keys or the busy one only; then the same in two runs, the second of which begins in the middle of a slice."""
    rng = random.Random(seed)
    rows = [(rng.choice("aaaaaabc"), round(rng.uniform(0, 3000), 6), i) for i in range(900)]
    rows = [r for r in rows if not 700 < r[1] < 1900]
    want = {t for _, _, t in kept_by_walk(rows, window)}
    options = {"slice_sec": slice_sec, "hot_steps": hot}
    assert run_dedup(spark, rows, window, **options) == want
    cut = sorted(r[1] for r in rows)[len(rows) // 3]
    first, rest = [r for r in rows if r[1] <= cut], [r for r in rows if r[1] > cut]
    kept = dedup.dedup_detections(detection_df(spark, first), window, order_cols=("tie",), **options)
    again = run_dedup(spark, rest, window, state=dedup.dedup_state(kept, None), **options)
    assert {r.tie for r in kept.collect()} | again == want


def test_dedup_continues_from_state(spark):
    rng = random.Random(9)
    rows = sorted(((rng.choice("ab"), rng.randrange(1000), i) for i in range(300)), key=lambda r: (r[1], r[2]))
    whole = run_dedup(spark, rows, 13, slice_sec=50)
    first, rest = rows[:140], rows[140:]
    kept = dedup.dedup_detections(detection_df(spark, first), 13, order_cols=("tie",), slice_sec=50)
    state = dedup.dedup_state(kept, None)
    got = {r.tie for r in kept.collect()} | run_dedup(spark, rest, 13, slice_sec=50, state=state)
    assert got == whole


def test_slice_exits_step_function():
    rng = np.random.default_rng(3)
    for _ in range(50):
        ts = np.unique(rng.integers(1000, 1200, rng.integers(1, 40)))
        window = int(rng.integers(1, 90))
        upper, exits = dedup.slice_exits(ts, 1000, window)
        for last in [None, *range(850, 1000)]:
            cur = last
            for t in ts:
                if cur is None or t - cur > window:
                    cur = int(t)
            i = 0 if last is None else int(np.searchsorted(upper, last, side="right"))
            assert (exits[i] if i < len(exits) else last) == cur


# --- frequencies ----------------------------------------------------------

@pytest.mark.parametrize("slice_us", [1, 3, 10, 1000])
def test_sliding_counts_equal_a_scan(spark, slice_us):
    rng = random.Random(slice_us)
    rows = [(rng.choice("aaab"), rng.randrange(120), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, us long, o int")
    got = {(r.k, r.us, r.o): (r.n5, r.n40) for r in anomaly.sliding_counts(df, "k", "us", "o", {"n5": 5, "n40": 40}, slice_us).collect()}
    five, forty = counts_by_scan(rows, 5), counts_by_scan(rows, 40)
    assert got == {r: (five[r], forty[r]) for r in rows}
    some = anomaly.sliding_counts(df, "k", "us", "o", {"n": 5}, slice_us, emit=F.col("o") % 3 == 0)
    assert {(r.k, r.us, r.o): r.n for r in some.collect()} == {r: five[r] for r in rows if r[2] % 3 == 0}


def test_traffic_spike(spark):
    times = [i * 60 for i in range(4)] + [240 + 2 * i for i in range(25)]
    df = norm(spark, *[dict(trace_id=f"t{i:03d}", type="SECURITY", boundary="auth-service:login", origin="AI_AGENT", timestamp=at(s))
                       for i, s in enumerate(times)])
    out = anomaly.detect_anomaly(df, 60, 300, 300.0, 3.0).collect()
    assert out and {r.event_name for r in out} == {"ANOMALY_DETECTED"} and out[0].payload.metric_key == "SECURITY|auth-service:login"
    quiet = norm(spark, *[dict(trace_id=f"t{i:03d}", timestamp=at(60 * i)) for i in range(40)])
    assert anomaly.detect_anomaly(quiet).count() == 0


def test_high_priority_and_default_limits(spark):
    """35 rows within the minute after a silent baseline: 1000 % of it."""
    df = norm(spark, *[dict(trace_id=f"t{i:03d}", timestamp=at(i)) for i in range(35)])
    out = {r.trace_id: r for r in anomaly.detect_anomaly(df).collect()}
    assert set(out) == {f"t{i:03d}" for i in range(29, 35)}
    assert all(r.priority == "HIGH" and r.score == 1.0 and r.payload.deviation_pct == 1000.0 for r in out.values())


# --- access ---------------------------------------------------------------

ROLES = {"writer": {"can_write": True, "allowed_log_types": ["system", "INFRA"], "max_log_level": 5},
         "strict": {"can_write": True, "denied_log_types": ["Debug"]}, "viewer": {"can_read": True}}


@pytest.mark.parametrize("joined", [False, True])
def test_write_access(spark, joined):
    clients = {"w": "writer", "s": "strict", "x": "missing"}
    table = spark.createDataFrame(list(clients.items()), "client_id string, role string") if joined else clients
    rows = [("w", "SYSTEM", 3), ("w", "SECURITY", 3), ("w", "INFRA", 6), ("w", "INFRA", 0), ("w", "", 1), ("w", None, 1), ("s", "DEBUG", 1),
            ("x", "SYSTEM", 1), ("", "SYSTEM", 1), (None, "SYSTEM", 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, client_id string, type string, level int")
    got = {r.i: r.deny_reason for r in access.with_deny_reason(df, table, ROLES).collect()}
    assert got == {0: None, 1: "log type SECURITY not allowed", 2: "log level 6 exceeds max 5", 3: None, 4: "log type  not allowed",
                   5: "log type  not allowed", 6: "log type DEBUG is denied", 7: "write permission denied",
                   8: "write permission denied", 9: "write permission denied"}
    allowed, denied = access.authorize_writes(df, table, ROLES)
    assert (allowed.count(), denied.count()) == (2, 8)
    assert {r.client_id for r in denied.filter("i > 7").collect()} == {"anonymous"}


# --- configuration --------------------------------------------------------

def test_config_defaults_and_errors():
    r = load_rules({"flow": {"service_id": "s"}})
    assert (r.threshold, r.anomaly_window_sec, r.default_strategy, r.default_role, r.max_loop_depth) == (0.5, 60, "NOTIFY_ONLY", "viewer", 5)
    for bad in ({}, {"flow": {"service_id": "s"}, "security": {"enable_hash_chain": True, "hmac_key": "short"}}):
        with pytest.raises(RuntimeError):
            load_rules(bad)
    assert log()["type"] == "SYSTEM" and LOG_SCHEMA["level"]


def test_required_texts():
    from logwarden.operators.rule_index import required_texts

    assert required_texts("by user 12$") == ["by user 12"] and required_texts("(?i)BRUTE\\s*force") == ["brute", "force"]
    assert required_texts("(?i)password leaked") == ["word lea"] and required_texts("(?i:Token)abc(?:DEF)(ghi)") == ["abcdef", "ghi"]
    for none in ("abc|def", "(abc)?", "[a-z]{9}", "(", "ab", "[[:alpha:]]foo", "\\pLabc", ""):
        assert required_texts(none) == []


def test_rules_by_index_fire_as_compiled_ones(spark):
    from logwarden.operators import rule_index

    rng = random.Random(4)
    words = ["disk full", "Login FAILED", "user 7 gone", "x", "", "Ünïcode failed", "kelvin K sign"]
    rows = [log(trace_id=f"t{i}", message=f"{rng.choice(words)} {rng.choice(words)}", type=rng.choice(["SECURITY", "SLA", "", None]), level=rng.choice([None, 0, 1, 3, 6, 9]),
                origin=rng.choice(["SYSTEM", "AI_AGENT"]), is_critical=rng.random() < 0.5,
                tags=[{"key": "ip", "category": "10.0.0.1"}] if rng.random() < 0.5 else []) for i in range(150)]
    df = spark.createDataFrame(rows, LOG_SCHEMA)
    patterns = ["", "", "failed", "(?i)failed", "(?i)kelvin k", "user \\d+ gone$", "x|disk", "^$", "[[:alpha:]]nïcode"]
    rules = [DynamicRule(
        f"r{i}", f"E{i}", priority=rng.choice(["HIGH", "none"]), score=rng.choice([0, 0.4]), payload_builder=rng.choice(["security_intrusion", "Compliance_Violation", "odd"]),
        log_types=rng.choice([(), ("SLA",), ("SLA", "SECURITY", "SLA")]), origins=rng.choice([(), ("SYSTEM",)]), min_level=rng.choice([0, 0, 2, 7]), max_level=rng.choice([0, 0, 3, 8]),
        message_pattern=rng.choice(patterns), require_critical=rng.choice([None, None, True, False]), tag_keys=rng.choice([(), ("ip",)])) for i in range(60)]
    columns = ["trace_id", "rule_pos", "event_name", "priority", "score", "rule_id", "payload"]
    want = sorted(map(str, detect.dynamic_rules(df, rules).select(*columns).collect()))
    assert want and sorted(map(str, rule_index.match_rules(df, rules).select(*columns).collect())) == want

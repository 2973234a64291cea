"""A stream cut into files gives what the batch form gives."""

import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logwarden.config import load_rules
from logwarden.operators import anomaly, dedup, detect, integrity
from logwarden.schemas import LOG_SCHEMA
from logwarden.sources import sinks
from logwarden.streaming import keyed
from logwarden.streaming.blocks import block_join_stream
from logwarden.streaming.tables import StreamFlow, detect_stream, split_late
from parity.inputs import SERVICE, norm_logs, raw_logs
from parity.rules import CONF, HMAC_KEY, rules
from parity.stubs import stub_inference


def write_parts(df, n=4):
    """The rows in ``n`` files by time; returns folder and the files in order."""
    folder = tempfile.mkdtemp(prefix="lw-stream-")
    lo, hi = df.agg(F.min("timestamp"), F.max("timestamp")).first()
    step = (hi - lo) / n
    for i in range(n):
        start, end = lo + step * i, lo + step * (i + 1)
        part = df.filter((F.col("timestamp") >= start) & (
            (F.col("timestamp") < end) if i < n - 1 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


LATER = datetime(2100, 1, 1)


def add_clock(df, folder):
    """A last file with one row far behind the others: it moves the watermark over all that waits."""
    df.limit(1).withColumn("timestamp", F.lit(LATER)).coalesce(1).write.mode("append").parquet(folder)


def run(spark, df, build, n=4, clock=False, order="time"):
    folder = write_parts(df, n) if order == "time" else write_shuffled(df, n)
    if clock:
        add_clock(df, folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out, check = tempfile.mkdtemp(prefix="lw-out-"), tempfile.mkdtemp(prefix="lw-check-")
    q = (build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
         .outputMode("append").trigger(availableNow=True).start())
    assert q.awaitTermination(240)
    return spark.read.parquet(out)


def write_shuffled(df, n):
    """The rows in ``n`` files without any order of time."""
    folder = tempfile.mkdtemp(prefix="lw-stream-")
    for i in range(n):
        part = df.filter(F.pmod(F.xxhash64("timestamp", "tie"), F.lit(n)) == i)
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def fired(spark, sf):
    rows = detect.explode_detections(
        detect.detect_ensemble(norm_logs(spark, sf), detect.ensemble_rules(rules().dynamic_rules)))
    return rows.withColumn("tie", F.format_string("%08d-%03d", "event_id", "rule_pos")).select(
        "timestamp", "event_name", "boundary", "service_id", "tie")


# Rows wait at most this long; with files in no order, it must cover all of them.
YEAR = {"delay": "400 days", "slot_sec": 86400, "until": LATER}


@pytest.mark.parametrize("order", ["time", "shuffled"])
def test_dedup_stream_equals_batch(spark, sf, order):
    rows = fired(spark, sf)
    batch = {r.tie for r in dedup.dedup_detections(rows, 21600, order_cols=("tie",)).collect()}
    options = {"until": LATER} if order == "time" else YEAR
    got = run(spark, rows, lambda s: keyed.dedup_stream(s, 21600, **options), clock=True, order=order)
    assert not got.filter("late").count()
    assert sorted(r.tie for r in got.collect()) == sorted(batch) and batch


@pytest.mark.parametrize("order", ["time", "shuffled"])
def test_anomaly_stream_equals_batch(spark, sf, order):
    logs = norm_logs(spark, sf).select("timestamp", "trace_id", "type", "boundary", F.col("trace_id").alias("tie"))
    conf = dict(window_sec=86400, baseline_sec=864000, threshold_pct=150.0, min_baseline=0.5)
    batch = {(r.trace_id, round(r.score, 6)) for r in anomaly.detect_anomaly(logs, **conf).collect()}
    options = {"until": LATER, "slot_sec": 7200} if order == "time" else YEAR
    got = run(spark, logs, lambda s: keyed.anomaly_stream(s, **conf, **options), clock=True, order=order)
    assert sorted((r.tie, round(r.score, 6)) for r in got.collect()) == sorted(batch) and batch


BLOCK_ROWS = [
    ("10.0.0.1", 0, 0, "b1"), ("10.0.0.1", 5, 2, "t1"), ("10.0.0.1", 10, 2, "t2"), ("10.0.0.1", 11, 2, "t3"),
    ("10.0.0.2", 1, 0, "b2"), ("10.0.0.2", 2, 1, "l2"), ("10.0.0.2", 3, 2, "t4"), ("10.0.0.3", 4, 2, "t5"),
    ("10.0.0.1", 20, 0, "b3"), ("10.0.0.1", 21, 2, "t6"), (None, 22, 2, "t7"), ("", 23, 2, "t8")]


def moves_of(spark, rows):
    return spark.createDataFrame(rows, "ip string, s int, kind int, tie string").select(
        "ip", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("timestamp"), "kind", "tie")


@pytest.mark.parametrize("order", ["time", "shuffled"])
def test_block_stream_expires(spark, order):
    df = moves_of(spark, BLOCK_ROWS)
    got = run(spark, df, lambda s: keyed.block_stream(s, 10, slot_sec=4, until=LATER), n=3, clock=True, order=order)
    assert {r.tie: (r.is_blocked, r.late) for r in got.collect()} == {
        "t1": (True, False), "t2": (True, False), "t3": (False, False), "t4": (False, False), "t5": (False, False), "t6": (True, False)}


def test_two_sources_meet_without_a_join(spark):
    """An address that is blocked, lifted and used at every moment: each row is taken once, rows do not meet in pairs."""
    moves = [("a", i * 7 % 1200, int(i % 3 == 0)) for i in range(600)] + [("b", 3, 0), ("b", 3, 1), ("c", 5, 0), (None, 4, 0), ("", 4, 0), ("d", 1, None)]
    used = [("a", i * 11 % 1300, f"t{i}") for i in range(600)] + [
        ("a", 4, "t1"), ("a", 4, "t1"), ("b", 3, "u1"), ("c", 5, "u2"), ("c", 15, "u3"), ("c", 16, "u4"), ("c", 5, None), ("d", 2, "u5"), (None, 1, "u6"), ("", 1, "u7")]

    def source(rows, schema):
        folder = tempfile.mkdtemp(prefix="lw-stream-")
        df = spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
        for part in (df.filter(F.pmod(F.hash("timestamp"), F.lit(2)) == i) for i in range(2)):
            part.coalesce(1).write.mode("append").parquet(folder)
        add_clock(df, folder)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    stream = block_join_stream(
        source(used, "ip string, s int, tie string"), source(moves, "ip string, s int, kind int"),
        10, "30 minutes", "40 minutes", LATER, slot_sec=60)
    assert "Join" not in stream._jdf.queryExecution().logical().toString()
    out, check = tempfile.mkdtemp(prefix="lw-out-"), tempfile.mkdtemp(prefix="lw-check-")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
         .outputMode("append").trigger(availableNow=True).start())
    assert q.awaitTermination(240)
    want = set()
    for ip, at, tie in used:
        if ip:
            last = max(((s, kind) for i, s, kind in moves if i == ip and kind is not None and at - 10 <= s <= at), default=None)
            live = last is not None and last[1] == 0
            want.add((ip, at, tie, last[0] * 1_000_000 if live else None, live))
    got = [(r.ip, r.s, r.tie, r.blocked_at_us, r.is_blocked) for r in spark.read.parquet(out).withColumn("s", F.unix_seconds("timestamp")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_rows_behind_the_watermark_are_marked_late(spark):
    """The third file is 90 seconds old with a delay of 20: only its rows are late, and they change nothing."""
    folder = tempfile.mkdtemp(prefix="lw-stream-")
    for rows in ([("a", 0, 0, "b"), ("a", 100, 2, "t1")], [("a", 85, 2, "t2")], [("a", 5, 1, "l"), ("a", 6, 2, "t3"), ("a", 101, 2, "t4")]):
        moves_of(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    add_clock(moves_of(spark, rows), folder)
    stream = spark.readStream.schema(moves_of(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out, check = tempfile.mkdtemp(prefix="lw-out-"), tempfile.mkdtemp(prefix="lw-check-")
    q = (keyed.block_stream(stream, 0, "20 seconds", slot_sec=10, until=LATER).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start())
    assert q.awaitTermination(240)
    got = {r.tie: (r.is_blocked, r.kind, r.late) for r in spark.read.parquet(out).collect()}
    assert got == {"t1": (True, 2, False), "t2": (True, 2, False), "t4": (True, 2, False), "l": (None, 1, True), "t3": (None, 2, True)}


def test_stateless_stage_streams(spark, sf):
    r = rules()
    r.authorization = False
    raw = raw_logs(spark, sf)
    want = {(x.trace_id, x.rule_id) for x in detect_stream(raw, r).select("trace_id", "rule_id").collect()}
    got = run(spark, raw, lambda s: detect_stream(s, r).select("trace_id", "rule_id"), n=2)
    assert {(x.trace_id, x.rule_id) for x in got.collect()} == want and want


def test_window_counts_stream(spark, sf):
    logs = norm_logs(spark, sf).select("timestamp", "type", "boundary")
    got = run(spark, logs, lambda s: keyed.window_counts(s, "2 days", "1 day", "1 day"), n=2)
    assert got.count() > 0


def test_split_late(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "s int").select(F.timestamp_seconds("s").alias("timestamp"))
    now, late = split_late(df, 5_000_000)
    assert (now.count(), late.count()) == (2, 1)


def stream_rules(**ensemble):
    conf = {**CONF, "masking_policies": [], "authorization": {},
            "ensemble": {**CONF["ensemble"], "dedup_window_sec": 21600, **ensemble},
            "anomaly": {"enabled": True, "window_size_sec": 86400, "baseline_window_sec": 864000,
                        "threshold_pct": 150.0, "min_baseline": 0.5}}
    r = load_rules(conf)
    r.service_id = SERVICE
    return r


def test_stream_flow_equals_batch(spark, sf):
    """Chains, repeats and anomalies continue over micro-batches; a replay changes nothing."""
    r = stream_rules()
    # Trace ids sort like arrival, so that ties break the same way.
    raw = raw_logs(spark, sf).withColumn("trace_id", F.format_string("ev-%08d", "event_id"))
    raw = raw.select(*[c for c in raw.columns if c in LOG_SCHEMA.fieldNames()])
    folder, root, check = write_parts(raw, 2), tempfile.mkdtemp(prefix="lw-t-"), tempfile.mkdtemp(prefix="lw-c-")
    feedback = tempfile.mkdtemp(prefix="lw-f-")
    seen, blocked = [], []
    job = StreamFlow(r, root, lanes=2, feedback=feedback, on_logs=lambda d: seen.append(d.count()), blocker=lambda d: blocked.append(d.count()),
                     default_handler=lambda d: d.count(), model=stub_inference)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = job.start(stream, check, availableNow=True)
    assert q.awaitTermination(400)

    from logwarden.plans import flow
    want_logs = flow.prepare(raw, r).logs
    logs = spark.read.parquet(f"{root}/chained")
    assert logs.count() == want_logs.count() == sum(seen)

    chain = ["service_id", "boundary", "chain_date"]
    report = integrity.chain_report(
        integrity.verify_chain(logs, chain, ["timestamp", "trace_id"], [HMAC_KEY]), chain, ["timestamp", "trace_id"])
    bad = report.agg(F.sum("links_broken"), F.sum("rows_altered")).first()
    assert tuple(bad) == (0, 0)
    whole = integrity.build_hash_chain(
        want_logs.withColumn("chain_date", F.to_date("timestamp").cast("string")), chain, ["timestamp", "trace_id"],
        HMAC_KEY, lanes=2)
    assert {tuple(x) for x in logs.select("trace_id", "hash").collect()} == {
        tuple(x) for x in whole.select("trace_id", "hash").collect()}

    want = {(x.trace_id, x.rule_id) for x in flow.detections_of(want_logs, r).collect()}
    found = spark.read.parquet(f"{root}/detections")
    assert {(x.trace_id, x.rule_id) for x in found.collect()} == want and any(x[1] == "anomaly-frequency" for x in want)

    before = {t: spark.read.parquet(f"{root}/{t}").count() for t in ("logs", "detections", "tasks", "outbox", "chain_heads", "blocks")}
    assert before["blocks"] == sum(blocked) == spark.read.parquet(f"{root}/responded").filter("block is not null").count() > 0
    part = spark.read.schema(raw.schema).parquet(folder)
    times = logs.filter(F.col(sinks.BATCH) == 1).agg(F.min("timestamp"), F.max("timestamp")).first()
    job(part.filter(F.col("timestamp").between(*times)), 1)
    after = {t: spark.read.parquet(f"{root}/{t}").count() for t in before}
    assert before == after
    fed = spark.read.schema(LOG_SCHEMA).parquet(feedback).filter("origin = 'AI_AGENT'")
    assert fed.count() == fed.select("trace_id").distinct().count() > 0
    assert fed.join(spark.read.parquet(f"{root}/chained"), "trace_id", "left_semi").count() == 0

"""Integrity, detection, anomalies, access."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.config import DynamicRule
from logwarden.functions.crypto import hmac_sha256, pads
from logwarden.operators import access, anomaly, dedup, detect, integrity, rule_index

from .inputs import NORM_CTE, RAW_CTE, norm_logs, raw_logs, table, us
from .registry import query
from .rules import HMAC_KEY, OLD_KEY, rules


def hmac_sql(text: str, key: bytes = HMAC_KEY) -> str:
    inner, outer = (p.hex() for p in pads(key))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({text}))))"


# --- canonical text and hashes --------------------------------------------

_TS = r"concat(regexp_replace(strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', ''), 'Z')"


def _js(col: str) -> str:
    return f"CAST(to_json({col}) AS VARCHAR)"


HEAD_SQL = f"""concat('{{"AIContext":', CASE WHEN origin = 'AI_AGENT' THEN
    concat('{{"AgentID":"agent-1","Confidence":0.5,"LoopDepth":', loop_depth, ',"Model":"m1","ReasoningTrace":',
      {_js('raw_message')}, ',"TaskID":""}}') ELSE 'null' END,
  ',"ActorID":', {_js('actor_id')}, ',"AgentBackLog":', CASE WHEN origin = 'AI_AGENT' THEN
    concat('[{{"Action":"look","AgentID":"agent-1","Result":', {_js('detail_note')},
      ',"Status":"success","Timestamp":"', {_TS}, '"}}]') ELSE 'null' END,
  ',"Boundary":', {_js('boundary')}, ',"Details":{{"note":', {_js('detail_note')}, ',"secret":', {_js('detail_secret')},
  '}},"Hash":"","Input":', {_js('input')}, ',"IsCritical":', CAST(is_critical AS VARCHAR), ',"Level":', level,
  ',"LogicalClock":', us // 1000, ',"Message":', {_js('message')}, ',"Origin":"', origin,
  '","ParentSpanID":"","PreviousHash":"')"""
TAIL_SQL = f"""concat('","ResourceIDs":[', CASE WHEN resource_id <> '' THEN {_js('resource_id')} ELSE '' END,
  '],"ServiceID":"', service_id, '","Signature":"","SpanID":"","Tags":[',
  CASE WHEN tag_ip <> '' THEN concat('{{"Category":', {_js('tag_ip')}, ',"Key":"ip"}}') ELSE '' END,
  '],"Timestamp":"', {_TS}, '","TraceID":', {_js('trace_id')}, ',"TriggerAgent":false,"Type":"', type, '"}}')"""
CANON_CTE = f"""{NORM_CTE}, canon AS (
  SELECT norm.*, CAST(CAST(event_ts AS DATE) AS VARCHAR) AS event_date, {HEAD_SQL} AS head, {TAIL_SQL} AS tail
  FROM norm JOIN (SELECT event_id AS rid, message AS raw_message FROM raw) r ON r.rid = norm.event_id)"""

CHAIN = ["boundary", "event_date"]
ORDER = ["timestamp", "event_id"]
LANE_ROWS = 30


def dated_logs(spark, sf):
    return norm_logs(spark, sf).withColumn("event_date", F.to_date("timestamp").cast("string"))


def chain_sql(digest: str, target_rows: int = LANE_ROWS) -> str:
    """Chains by recursion: ``digest`` is SQL over m, the text to hash."""
    first, nxt = digest.replace("m!", "concat(head, tail)"), digest.replace(
        "m!", "concat(o.head, c.hash, o.tail, c.hash)")
    return f"""
    WITH RECURSIVE {CANON_CTE},
    sized AS (SELECT *, count(*) OVER (PARTITION BY boundary, event_date) AS n FROM canon),
    laned AS (SELECT *, CASE WHEN n > {target_rows}
        THEN CAST(('0x' || substr(md5(trace_id), 1, 8)) AS BIGINT) % CAST(ceil(n / {target_rows}) AS BIGINT)
        ELSE 0 END AS lane FROM sized),
    o AS (SELECT event_id, boundary, event_date, lane, head, tail, row_number() OVER (
        PARTITION BY boundary, event_date, lane ORDER BY us, event_id) AS rn FROM laned),
    c AS (
      SELECT event_id, boundary, event_date, lane, rn, '' AS previous_hash, {first} AS hash FROM o WHERE rn = 1
      UNION ALL
      SELECT o.event_id, o.boundary, o.event_date, o.lane, o.rn, c.hash, {nxt}
      FROM c JOIN o ON o.boundary = c.boundary AND o.event_date = c.event_date AND o.lane = c.lane AND o.rn = c.rn + 1)
    """


@query("canonical_json", f"""
    WITH {CANON_CTE} SELECT event_id, concat(head, tail) AS canonical FROM canon
""")
def _(spark, sf):
    return integrity.canonical_json(norm_logs(spark, sf)).select("event_id", "canonical")


@query("hmac_sha256", f"SELECT doc_id, {hmac_sql('text')} AS mac, {hmac_sql('text', OLD_KEY * 3)} AS long_key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", hmac_sha256(F.col("text"), HMAC_KEY).alias("mac"),
        hmac_sha256(F.col("text"), OLD_KEY * 3).alias("long_key"))


@query("build_hash_chain", chain_sql(hmac_sql("m!")) + "SELECT event_id, lane::BIGINT AS lane, previous_hash, hash FROM c")
def _(spark, sf):
    out = integrity.build_hash_chain(dated_logs(spark, sf), CHAIN, ORDER, HMAC_KEY, LANE_ROWS)
    return out.select("event_id", F.col("chain_lane").cast("bigint").alias("lane"), "previous_hash", "hash")


@query("build_sha_chain", chain_sql("sha256(m!)", 10**9) + "SELECT event_id, previous_hash, hash FROM c")
def _(spark, sf):
    out = integrity.build_sha_chain(dated_logs(spark, sf), CHAIN, ORDER)
    return out.select("event_id", "previous_hash", "hash")


@query("chain_heads", chain_sql(hmac_sql("m!")) + f"""
    , h AS (SELECT boundary, event_date, lane, count(*)::BIGINT AS n_rows, max_by(hash, rn) AS head_hash FROM c GROUP BY ALL)
    SELECT boundary, event_date, lane::BIGINT AS lane, n_rows, head_hash,
      {hmac_sql("concat_ws('|', boundary, event_date, lane, n_rows, head_hash)")} AS head_signature FROM h""")
def _(spark, sf):
    out = integrity.build_hash_chain(dated_logs(spark, sf), CHAIN, ORDER, HMAC_KEY, LANE_ROWS)
    heads = integrity.chain_heads(out, CHAIN, ORDER, HMAC_KEY)
    return heads.withColumn("lane", F.col("chain_lane").cast("bigint")).drop("chain_lane")


@query("verify_chain", f"""
    WITH {NORM_CTE} SELECT CAST(CAST(event_ts AS DATE) AS VARCHAR) AS event_date, boundary, count(*)::BIGINT AS n_rows,
      0::BIGINT AS links_broken, count(*) FILTER (event_id % 500 = 7)::BIGINT AS rows_altered
    FROM norm GROUP BY ALL
""")
def _(spark, sf):
    """Rows altered after hashing are found, and nothing else is."""
    built = integrity.build_hash_chain(dated_logs(spark, sf), CHAIN, ORDER, HMAC_KEY)
    altered = built.withColumn("message", F.when(F.col("event_id") % 500 == 7, F.concat("message", F.lit("!")))
                               .otherwise(F.col("message")))
    report = integrity.chain_report(integrity.verify_chain(altered, CHAIN, ORDER, [HMAC_KEY]), CHAIN, ORDER)
    return report.select("boundary", "event_date", "n_rows", "links_broken", "rows_altered")


@query("verify_chain_rotation", f"""
    WITH {NORM_CTE} SELECT CASE WHEN event_ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END::BIGINT AS key_index,
      count(*)::BIGINT AS n FROM norm GROUP BY ALL
""")
def _(spark, sf):
    """Days hashed under the old key verify under [current, old]."""
    logs = dated_logs(spark, sf)
    early = F.col("event_date") < "2024-01-15"
    built = integrity.build_hash_chain(logs.filter(early), CHAIN, ORDER, OLD_KEY).unionByName(
        integrity.build_hash_chain(logs.filter(~early), CHAIN, ORDER, HMAC_KEY))
    seen = integrity.verify_chain(built, CHAIN, ORDER, [HMAC_KEY, OLD_KEY])
    return seen.groupBy(F.col("key_index").cast("bigint").alias("key_index")).agg(F.count(F.lit(1)).alias("n"))


@query("agent_input_hash", f"""
    WITH {NORM_CTE}
    SELECT event_id, substr(sha256(concat('{{"message":', {_js('message')}, ',"traceId":', {_js('trace_id')}, '}}')), 1, 32) AS input_hash
    FROM norm
""")
def _(spark, sf):
    return integrity.agent_input_hash(norm_logs(spark, sf)).select("event_id", "input_hash")


@query("sign_payload", f"SELECT event_id, {hmac_sql('props')} AS signature FROM events")
def _(spark, sf):
    return integrity.sign_payload(table(spark, sf, "events"), "props", HMAC_KEY).select("event_id", "signature")


# --- detection ------------------------------------------------------------

_NONE = "NULL AS component, NULL AS error_details, NULL AS ip, NULL AS severity, NULL AS rule_ref, NULL AS document_id, NULL AS user_id"
_IP = "CASE WHEN tag_ip = '' THEN '0.0.0.0' ELSE tag_ip END"
_DOC = "CASE WHEN resource_id = '' THEN 'unknown' ELSE resource_id END"
_USER = "CASE WHEN actor_id = '' THEN 'system' ELSE actor_id END"


def _payload_sql(kind: str, **f: str) -> str:
    names = ("component", "error_details", "ip", "severity", "rule_ref", "document_id", "user_id")
    return f"'{kind}' AS kind, " + ", ".join(f"{f.get(n, 'NULL')} AS {n}" for n in names)


_SYSTEM = _payload_sql("system_critical", component="boundary", error_details="message")
_INTRUSION = _payload_sql("security_intrusion", ip=_IP, severity="level")


def _compliance(ref: str) -> str:
    return _payload_sql("compliance_violation", rule_ref=f"'{ref}'", document_id=_DOC, user_id=_USER)


# (event, priority, score, rule id, payload, condition)
RULES_SQL = [
    ("SYSTEM_CRITICAL_FAILURE", "HIGH", 1.0, "builtin-critical", _SYSTEM, "is_critical"),
    ("SECURITY_INTRUSION_DETECTED", "HIGH", 0.9, "builtin-security", _INTRUSION, "type = 'SECURITY' AND level >= 5"),
    ("COMPLIANCE_VIOLATION", "HIGH", 0.85, "builtin-compliance", _compliance("AUTO-DETECT-001"),
     "type = 'COMPLIANCE' AND contains(lower(message), 'violation')"),
    ("SYSTEM_CRITICAL_FAILURE", "MEDIUM", 0.7, "builtin-sla",
     _payload_sql("system_critical", component="boundary", error_details="concat('SLA violation: ', message)"),
     "type = 'SLA' AND level >= 4"),
    ("SECURITY_INTRUSION_DETECTED", "HIGH", 0.95, "brute-force", _INTRUSION,
     r"type = 'SECURITY' AND level >= 4 AND regexp_matches(message, '(?i)brute\s*force')"),
    ("COMPLIANCE_VIOLATION", "MEDIUM", 1.0, "tagged", _compliance("tagged"),
     "origin = 'SYSTEM' AND level <= 3 AND tag_ip <> '' AND NOT is_critical"),
    ("AI_ACTION_REQUIRED", "LOW", 0.3, "faint", _SYSTEM, "type IN ('BUSINESS-AUDIT','SYSTEM') AND level >= 5"),
]


def fired_cte(picks=range(len(RULES_SQL)), source: str = "norm") -> str:
    parts = []
    for pos, i in enumerate(picks):
        e, p, s, rid, body, cond = RULES_SQL[i]
        parts.append(
            f"SELECT *, {pos} AS rule_pos, '{e}' AS event_name, '{p}' AS priority, CAST({s} AS DOUBLE) AS score, "
            f"'{rid}' AS rule_id, {body} FROM {source} WHERE (origin <> 'AI_AGENT' OR is_critical) AND {cond}")
    return "fired AS (" + "\nUNION ALL ".join(parts) + ")"


FIRED_CTE = f"{NORM_CTE}, {fired_cte()}"
PAYLOAD_FIELDS = ("kind", "component", "error_details", "ip", "severity", "rule_ref", "document_id", "user_id")
PRIO_SQL = "CASE priority WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"


def payload_cols():
    return [(F.col(f"payload.{f}").cast("bigint") if f == "severity" else F.col(f"payload.{f}")).alias(f)
            for f in PAYLOAD_FIELDS]


def payload_sql_cols() -> str:
    return ", ".join(f"CAST({f} AS BIGINT) AS {f}" if f == "severity" else f for f in PAYLOAD_FIELDS)


def ensemble(spark, sf):
    return detect.detect_ensemble(norm_logs(spark, sf), detect.ensemble_rules(rules().dynamic_rules))


@query("detectable", f"WITH {NORM_CTE} SELECT event_id FROM norm WHERE origin <> 'AI_AGENT' OR is_critical")
def _(spark, sf):
    return detect.detectable(norm_logs(spark, sf)).select("event_id")


def _one_rule(name: str, index: int, rule) -> None:
    @query(name, f"WITH {NORM_CTE}, {fired_cte([index])} SELECT event_id, event_name, priority, {payload_sql_cols()} FROM fired")
    def _(spark, sf):
        return detect.detect_first(norm_logs(spark, sf), [rule]).select(
            "event_id", "event_name", "priority", *payload_cols())


_one_rule("critical_rule", 0, detect.critical_rule)
_one_rule("intrusion_rule", 1, detect.intrusion_rule)
_one_rule("compliance_rule", 2, detect.compliance_rule)
_one_rule("sla_rule", 3, detect.sla_rule)


@query("detect_first", f"""
    WITH {NORM_CTE}, {fired_cte(range(4))},
    first AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rule_pos) AS rn FROM fired)
    SELECT event_id, event_name, priority, CAST(0 AS DOUBLE) AS score, '' AS rule_id, {payload_sql_cols()} FROM first WHERE rn = 1
""")
def _(spark, sf):
    return detect.detect_first(norm_logs(spark, sf)).select(
        "event_id", "event_name", "priority", "score", "rule_id", *payload_cols())


@query("dynamic_rules", f"""
    WITH {NORM_CTE}, {fired_cte([4, 5, 6])}
    SELECT event_id, rule_pos::BIGINT AS rule_pos, event_name, priority, score, rule_id, {payload_sql_cols()} FROM fired
""")
def _(spark, sf):
    return detect.dynamic_rules(norm_logs(spark, sf), rules().dynamic_rules).select(
        "event_id", F.col("rule_pos").cast("bigint").alias("rule_pos"), "event_name", "priority", "score", "rule_id",
        *payload_cols())


MANY = 2000


def many_rules() -> list[DynamicRule]:
    """Rules by type and level, rules for a user each, and some whose pattern has no fixed text."""
    types = ("SECURITY", "COMPLIANCE", "SLA", "BUSINESS-AUDIT", "SYSTEM")
    builders = ("security_intrusion", "compliance_violation", "other")
    made = []
    for i in range(MANY):
        more = {"rule_id": f"r-{i}", "event_name": f"EVENT_{i % 9}", "priority": ("HIGH", "LOW", "odd")[i % 3], "score": (i % 10) / 10, "payload_builder": builders[i % 3]}
        if i % 20 == 0:
            more |= {"log_types": (types[i // 20 % 5],), "min_level": 4 + i // 100 % 3, "require_critical": (None, True, False)[i // 20 % 3],
                     "tag_keys": ("ip",) if i % 60 == 0 else ()}
        elif i % 20 == 1:
            more |= {"message_pattern": f"[bB][yY].*[^0-9]{i % 50}$", "max_level": 3, "log_types": (types[i // 20 % 5],)}
        else:
            more |= {"message_pattern": f"by user {i}$", "max_level": 3 + i % 4, "origins": ("SYSTEM",) if i % 2 else ()}
        made.append(DynamicRule(**more))
    return made


def _rule_rows() -> str:
    rows = []
    for i, r in enumerate(many_rules()):
        critical = "NULL" if r.require_critical is None else str(r.require_critical).lower()
        rows.append(f"({i}, '{r.rule_id}', '{r.event_name}', '{r.priority if r.priority != 'odd' else 'MEDIUM'}', {r.score or 1.0}, '{r.payload_builder}', "
                    f"'{''.join(r.log_types)}', '{''.join(r.origins)}', {r.min_level}, {r.max_level}, {critical}, {str(bool(r.tag_keys)).lower()}, '{r.message_pattern if r.message_pattern.startswith("[") else ""}', "
                    f"'{r.message_pattern.removesuffix("$") if r.message_pattern.startswith("by") else ""}')")
    return ", ".join(rows)


@query("many_rules", f"""
    WITH {NORM_CTE}, rules(rule_pos, rule_id, event_name, priority, score, builder, types, origins, min_level, max_level, critical, tagged, pattern, tail) AS (
      VALUES {_rule_rows()})
    SELECT event_id, rule_pos::BIGINT AS rule_pos, event_name, priority, CAST(score AS DOUBLE) AS score, rule_id,
      CASE builder WHEN 'other' THEN 'system_critical' ELSE builder END AS kind, CASE builder WHEN 'compliance_violation' THEN rule_id END AS rule_ref
    FROM norm n JOIN rules r ON (tail = '' OR suffix(n.message, tail)) AND (r.types = '' OR n.type = r.types)
      AND (r.origins = '' OR n.origin = r.origins) AND (min_level = 0 OR n.level >= min_level) AND (max_level = 0 OR n.level <= max_level)
      AND (critical IS NULL OR n.is_critical = critical) AND (NOT tagged OR n.tag_ip <> '')
      AND CASE WHEN pattern = '' THEN true ELSE regexp_matches(n.message, pattern) END
    WHERE n.origin <> 'AI_AGENT' OR n.is_critical
""")
def _(spark, sf):
    """Two thousand configured rules by index."""
    return rule_index.match_rules(norm_logs(spark, sf), many_rules()).select(
        "event_id", F.col("rule_pos").cast("bigint").alias("rule_pos"), "event_name", "priority", "score", "rule_id",
        F.col("payload.kind").alias("kind"), F.col("payload.rule_ref").alias("rule_ref"))


@query("build_payload", f"""
    WITH {NORM_CTE}, b AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'System_Critical' WHEN 1 THEN 'security_intrusion'
      WHEN 2 THEN 'compliance_violation' ELSE 'whatever' END AS builder FROM norm)
    SELECT event_id, CASE builder WHEN 'security_intrusion' THEN 'security_intrusion'
        WHEN 'compliance_violation' THEN 'compliance_violation' ELSE 'system_critical' END AS kind,
      CASE WHEN event_id % 4 IN (0, 3) THEN boundary END AS component,
      CASE WHEN event_id % 4 IN (0, 3) THEN message END AS error_details,
      CASE WHEN event_id % 4 = 1 THEN {_IP} END AS ip,
      CASE WHEN event_id % 4 = 1 THEN level END::BIGINT AS severity,
      CASE WHEN event_id % 4 = 2 THEN 'r-1' END AS rule_ref,
      CASE WHEN event_id % 4 = 2 THEN {_DOC} END AS document_id,
      CASE WHEN event_id % 4 = 2 THEN {_USER} END AS user_id FROM b
""")
def _(spark, sf):
    df = norm_logs(spark, sf)
    kinds = ["System_Critical", "security_intrusion", "compliance_violation", "whatever"]
    body = F.when(F.lit(False), detect.build_payload(kinds[0]))
    for i, k in enumerate(kinds):
        body = body.when(F.col("event_id") % 4 == i, detect.build_payload(k, "r-1"))
    return df.select("event_id", body.alias("payload")).select("event_id", *payload_cols())


@query("detect_ensemble", f"""
    WITH {FIRED_CTE}
    SELECT event_id, rule_pos::BIGINT AS rule_pos, event_name, priority, score, rule_id, {payload_sql_cols()} FROM fired
""")
def _(spark, sf):
    return detect.explode_detections(ensemble(spark, sf)).select(
        "event_id", F.col("rule_pos").cast("bigint").alias("rule_pos"), "event_name", "priority", "score", "rule_id",
        *payload_cols())


@query("aggregate_score", f"""
    WITH {FIRED_CTE}
    SELECT event_id, max(score) AS s_max, round(avg(score), 6) AS s_avg, round(least(sum(score), 1.0), 6) AS s_sum
    FROM fired GROUP BY event_id
""")
def _(spark, sf):
    d = F.col("detections")
    return ensemble(spark, sf).select(
        "event_id", detect.aggregate_score(d, "max").alias("s_max"),
        F.round(detect.aggregate_score(d, "avg"), 6).alias("s_avg"),
        F.round(detect.aggregate_score(d, "weighted_sum"), 6).alias("s_sum"))


@query("apply_threshold", f"""
    WITH {FIRED_CTE}, s AS (SELECT *, avg(score) OVER (PARTITION BY event_id) AS agg FROM fired)
    SELECT event_id, rule_id, round(agg, 6) AS aggregate_score FROM s WHERE agg >= 0.75
""")
def _(spark, sf):
    kept = detect.apply_threshold(ensemble(spark, sf), "avg", 0.75)
    return detect.explode_detections(kept).select(
        "event_id", "rule_id", F.round("aggregate_score", 6).alias("aggregate_score"))


@query("top_detection", f"""
    WITH {FIRED_CTE}, t AS (SELECT *, row_number() OVER (PARTITION BY event_id
      ORDER BY {PRIO_SQL} DESC, score DESC, rule_pos) AS rn FROM fired)
    SELECT event_id, event_name, priority, score, rule_id FROM t WHERE rn = 1
""")
def _(spark, sf):
    return detect.top_detection(ensemble(spark, sf)).select("event_id", "event_name", "priority", "score", "rule_id")


DEDUP_SEC = 21600
DEDUP_CTE = f"""{FIRED_CTE},
    o AS (SELECT event_id, rule_pos, us, concat_ws('|', event_name, boundary, service_id) AS k,
          row_number() OVER (PARTITION BY event_name, boundary, service_id ORDER BY us, event_id, rule_pos) AS rn FROM fired),
    walk AS (
      SELECT event_id, rule_pos, k, rn, us AS last_us, true AS kept FROM o WHERE rn = 1
      UNION ALL
      SELECT o.event_id, o.rule_pos, o.k, o.rn,
        CASE WHEN o.us - w.last_us > {DEDUP_SEC} * 1000000::BIGINT THEN o.us ELSE w.last_us END,
        o.us - w.last_us > {DEDUP_SEC} * 1000000::BIGINT
      FROM walk w JOIN o ON o.k = w.k AND o.rn = w.rn + 1)"""


def deduped(spark, sf):
    rows = detect.explode_detections(ensemble(spark, sf))
    return dedup.dedup_detections(rows, DEDUP_SEC, order_cols=("event_id", "rule_pos"))


@query("dedup_detections", f"WITH RECURSIVE {DEDUP_CTE} SELECT event_id, rule_pos::BIGINT AS rule_pos FROM walk WHERE kept")
def _(spark, sf):
    return deduped(spark, sf).select("event_id", F.col("rule_pos").cast("bigint").alias("rule_pos"))


@query("dedup_then_threshold", f"""
    WITH RECURSIVE {DEDUP_CTE},
    s AS (SELECT f.event_id, f.rule_id, least(sum(f.score) OVER (PARTITION BY f.event_id), 1.0) AS agg
          FROM fired f JOIN walk w ON w.event_id = f.event_id AND w.rule_pos = f.rule_pos AND w.kept)
    SELECT event_id, rule_id, round(agg, 6) AS aggregate_score FROM s WHERE agg >= 0.8
""")
def _(spark, sf):
    kept = detect.threshold_rows(deduped(spark, sf), "weighted_sum", 0.8, ("event_id",))
    return kept.select("event_id", "rule_id", F.round("aggregate_score", 6).alias("aggregate_score"))


@query("dedup_traffic", """
    WITH RECURSIVE o AS (SELECT event_id, epoch_us(ts) AS us, event_type,
      row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
      SELECT event_id, event_type, rn, us AS last_us, true AS kept FROM o WHERE rn = 1
      UNION ALL
      SELECT o.event_id, o.event_type, o.rn,
        CASE WHEN o.us - w.last_us > 7200000000 THEN o.us ELSE w.last_us END, o.us - w.last_us > 7200000000
      FROM walk w JOIN o ON o.event_type = w.event_type AND o.rn = w.rn + 1)
    SELECT event_id FROM walk WHERE kept
""")
def _(spark, sf):
    """Few keys, many rows each: every key is walked in many slices."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), "event_type")
    return dedup.dedup_detections(
        rows, 7200, order_cols=("event_id",), key=F.col("event_type"), slice_sec=10800).select("event_id")


# --- anomalies ------------------------------------------------------------

@query("metric_key", f"WITH {NORM_CTE} SELECT concat_ws('|', type, boundary) AS metric_key, count(*)::BIGINT AS n FROM norm GROUP BY ALL")
def _(spark, sf):
    return norm_logs(spark, sf).groupBy(anomaly.metric_key().alias("metric_key")).agg(F.count(F.lit(1)).alias("n"))


@query("sliding_count", """
    WITH e AS (SELECT event_id, event_type, epoch_us(date_trunc('hour', ts)) AS us FROM events)
    SELECT event_id, (count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)
      - count(*) OVER (PARTITION BY event_type, us) + row_number() OVER (PARTITION BY event_type, us ORDER BY event_id))::BIGINT AS n
    FROM e
""")
def _(spark, sf):
    """Hour-wide times: many ties, counted in arrival order."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, sf, "events").select(
        "event_id", "event_type", F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("us"))
    return anomaly.sliding_count(e, "event_type", "us", "event_id", 86_400_000_000, slice_us=3_600_000_000 * 5).select(
        "event_id", "n")


ANOMALY = {"window_sec": 86400, "baseline_sec": 864000, "threshold_pct": 200.0, "min_baseline": 3.0}
ANOMALY_CTE = """counts AS (
      SELECT *, concat_ws('|', type, boundary) AS metric_key,
        count(*) OVER (PARTITION BY type, boundary ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS cw,
        count(*) OVER (PARTITION BY type, boundary ORDER BY us RANGE BETWEEN 864000000000 PRECEDING AND CURRENT ROW) AS cb
      FROM norm),
    scored AS (SELECT *, cb / 10.0 AS baseline, cw / (cb / 10.0) * 100 AS deviation_pct FROM counts WHERE cb / 10.0 >= 3),
    anomalies AS (SELECT *, CASE WHEN deviation_pct >= 500 THEN 'HIGH' ELSE 'MEDIUM' END AS prio,
      least(deviation_pct / 1000, 1.0) AS sc FROM scored WHERE deviation_pct >= 200)"""


@query("detect_anomaly", f"""
    WITH {NORM_CTE}, {ANOMALY_CTE}
    SELECT trace_id, metric_key, round(baseline, 6) AS baseline, cw::DOUBLE AS observed,
      round(deviation_pct, 6) AS deviation_pct, prio AS priority, round(sc, 6) AS score, 'anomaly-frequency' AS rule_id
    FROM anomalies
""")
def _(spark, sf):
    p = F.col("payload")
    return anomaly.detect_anomaly(norm_logs(spark, sf), **ANOMALY).select(
        "trace_id", p["metric_key"].alias("metric_key"), F.round(p["baseline"], 6).alias("baseline"),
        p["observed"].alias("observed"), F.round(p["deviation_pct"], 6).alias("deviation_pct"), "priority",
        F.round("score", 6).alias("score"), "rule_id")


# --- access ---------------------------------------------------------------

_ROLE = """CASE client_id WHEN 'client-0' THEN 'admin' WHEN 'client-1' THEN 'writer' WHEN 'client-2' THEN 'auditor'
  WHEN 'client-3' THEN 'gone' ELSE 'viewer' END"""


@query("resolve_permissions", f"""
    WITH {RAW_CTE}
    SELECT event_id, {_ROLE} AS role, {_ROLE} IN ('admin','writer','auditor') AS can_write,
      {_ROLE} IN ('admin','writer','viewer') AS can_read, {_ROLE} IN ('admin','auditor') AS can_approve,
      CASE WHEN {_ROLE} = 'writer' THEN 5 ELSE 0 END::BIGINT AS max_log_level FROM raw
""")
def _(spark, sf):
    r = rules()
    p = F.col("permission")
    return access.resolve_permissions(raw_logs(spark, sf), r.client_roles, r.roles, r.default_role).select(
        "event_id", "role", p["can_write"].alias("can_write"), p["can_read"].alias("can_read"),
        p["can_approve"].alias("can_approve"), p["max_log_level"].cast("bigint").alias("max_log_level"))


@query("authorize_writes", f"""
    WITH {RAW_CTE}, r AS (SELECT *, {_ROLE} AS role FROM raw)
    SELECT event_id, CASE WHEN role NOT IN ('admin','writer','auditor') THEN 'write permission denied'
      WHEN role = 'writer' AND type = 'SLA' THEN 'log type SLA is denied'
      WHEN role = 'auditor' AND type NOT IN ('COMPLIANCE','SECURITY') THEN concat('log type ', type, ' not allowed')
      WHEN role = 'writer' AND level > 5 THEN concat('log level ', level, ' exceeds max 5') END AS deny_reason FROM r
""")
def _(spark, sf):
    """The client table given as a DataFrame: the joined form."""
    r = rules()
    return access.with_deny_reason(
        raw_logs(spark, sf), r.frame(spark, "client_roles"), r.roles, r.default_role).select("event_id", "deny_reason")


@query("authorized_approvers", f"WITH {RAW_CTE} SELECT event_id FROM raw WHERE client_id IN ('client-0','client-2')")
def _(spark, sf):
    r = rules()
    return access.authorized_approvers(raw_logs(spark, sf), r.client_roles, r.roles, r.default_role).select("event_id")


@query("authorized_admins", f"WITH {RAW_CTE} SELECT event_id FROM raw WHERE client_id = 'client-0'")
def _(spark, sf):
    r = rules()
    return access.authorized_admins(raw_logs(spark, sf), r.client_roles, r.roles, r.default_role).select("event_id")


__all__ = ["ANOMALY", "ANOMALY_CTE", "DynamicRule", "FIRED_CTE", "deduped", "ensemble", "us"]

"""Sources, normalisation, validation, masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.config import MaskRule
from logwarden.functions import pii, text
from logwarden.operators import masking, normalize, validate
from logwarden.sources import logs as sources
from logwarden.sources import sinks

from .inputs import CONTROL_SQL, NORM_CTE, RAW_CTE, WS_SQL, norm_logs, raw_logs, scratch, table, us
from .registry import query
from .rules import rules

# The personal-data patterns in the RE2 dialect.
RE2 = {
    "EMAIL": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "CREDIT_CARD": r"\b(?:\d[ \-]*?){13,19}\b",
    "PHONE": r"(\+81|0)\d{1,4}[\- ]?\d{1,4}[\- ]?\d{4}",
    "GOVERNMENT_ID": r"\b\d{12}\b",
    "JAPAN_ACCOUNT": r"\b\d{4}[\-]\d{3}[\-]\d{7}\b",
    "POSTAL_CODE": r"〒?\d{3}[\-]\d{4}",
    "DRIVER_LICENSE": r"\b\d{2}\d{2}\d{6}\d{2}\b",
    "HEALTH_INSURANCE": r"\b\d{2}\d{6}\b",
}
RE2_CLIENT = {
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b",
    "PHONE": r"(\+81|0)\d{1,4}[- ]?\d{1,4}[- ]?\d{4}",
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "GOVERNMENT_ID": r"\b\d{12}\b",
    "JAPAN_ACCOUNT": r"\d{3}[-]\d{7}|\d{4}[-]\d{7}",
    "POSTAL_CODE": r"(?:〒?\s?)?\d{3}[-]?\d{4}",
    "DRIVER_LICENSE": r"\b[1-9]\d{5,7}[0-9\\*]\d{2,4}\b",
    "HEALTH_INSURANCE": r"[A-Z0-9]{8,10}",
}
SERVER_SIX = ("EMAIL", "CREDIT_CARD", "PHONE", "GOVERNMENT_ID", "JAPAN_ACCOUNT", "POSTAL_CODE")
CLIENT_ALL = ("EMAIL", "CREDIT_CARD", "PHONE", "GOVERNMENT_ID", "JAPAN_ACCOUNT", "POSTAL_CODE",
              "DRIVER_LICENSE", "HEALTH_INSURANCE")


def mask_sql(col: str, categories=SERVER_SIX, table=RE2) -> str:
    for c in categories:
        col = f"regexp_replace({col}, '{table[c]}', '[MASKED_{c}]', 'g')"
    return col


def contains_sql(col: str, table=RE2) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{p}')" for p in table.values()) + ")"


def six_rules() -> list[MaskRule]:
    return [MaskRule("PII_TYPE", category=c) for c in SERVER_SIX]


# --- sources and sinks ----------------------------------------------------

@query("decode_log_json", f"""
    WITH {RAW_CTE}
    SELECT event_id,
      CASE WHEN tag_ip <> '' THEN 1 ELSE 0 END::BIGINT AS n_tags,
      CASE WHEN tag_ip <> '' THEN tag_ip END AS first_tag,
      CASE WHEN resource_id <> '' THEN resource_id END AS first_resource_id,
      CASE WHEN origin = 'AI_AGENT' THEN loop_depth END::BIGINT AS loop_depth,
      detail_note AS note,
      CAST(props ->> 'k' AS BIGINT) AS k
    FROM raw JOIN (SELECT event_id AS pid, props FROM events) p ON p.pid = raw.event_id
""")
def _(spark, sf):
    stored = sources.encode_log_json(raw_logs(spark, sf)).join(
        table(spark, sf, "events").select("event_id", "props"), "event_id")
    df = sources.decode_log_json(stored)
    return df.select(
        "event_id", F.size("tags").cast("bigint").alias("n_tags"),
        F.get("tags.category", F.lit(0)).alias("first_tag"),
        F.get("resource_ids", F.lit(0)).alias("first_resource_id"),
        F.col("ai_context.loop_depth").cast("bigint").alias("loop_depth"),
        F.try_element_at("details", F.lit("note")).alias("note"),
        F.from_json("props", "k bigint")["k"].alias("k"))


@query("read_logs", f"""
    WITH {RAW_CTE}
    SELECT event_id, trace_id, type, level::BIGINT AS level, epoch_us(event_ts) AS us, origin, boundary, message FROM raw
""")
def _(spark, sf):
    records = raw_logs(spark, sf)
    encoded = records.select("event_id", F.to_json(F.struct(*records.columns), sources.JSON_WRITE).alias("value"))
    parsed = encoded.select("event_id", F.from_json("value", sources.LOG_SCHEMA).alias("l")).select("event_id", "l.*")
    return us(sources._arrival(parsed)).select(
        "event_id", "trace_id", "type", F.col("level").cast("bigint").alias("level"), "us", "origin", "boundary", "message")


@query("append_logs", f"""
    WITH {RAW_CTE}, keyed AS (
      SELECT event_id, concat('t-', CAST(event_id % 5000 AS VARCHAR)) AS trace_id, event_ts FROM raw)
    SELECT event_id, trace_id,
      row_number() OVER (PARTITION BY trace_id ORDER BY event_ts, event_id) > 1
        OR trace_id IN (SELECT concat('t-', CAST(event_id % 100 AS VARCHAR)) FROM raw WHERE event_id % 100 < 10) AS degraded
    FROM keyed
""")
def _(spark, sf):
    logs = raw_logs(spark, sf).withColumn(
        "trace_id", F.concat(F.lit("t-"), (F.col("event_id") % 5000).cast("string")))
    stored = raw_logs(spark, sf).filter("event_id % 100 < 10").select(
        F.concat(F.lit("t-"), (F.col("event_id") % 100).cast("string")).alias("trace_id"))
    marked = sinks.mark_duplicates(logs, stored, ("timestamp", "event_id"))
    return marked.select("event_id", "trace_id", "degraded")


@query("append_batches", f"""
    WITH {RAW_CTE}, keyed AS (
      SELECT event_id, event_id % 3 AS batch, concat('t-', CAST(event_id * 7 % 4001 AS VARCHAR)) AS trace_id, event_ts FROM raw),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY batch, event_ts, event_id) AS n FROM keyed)
    SELECT event_id, trace_id, batch::BIGINT AS batch, n > 1 AS degraded, n = 1 AS stored FROM ranked
""")
def _(spark, sf):
    """Three batches through the log sink: repeats inside a batch and of earlier ones are refused, all others are in the table."""
    logs = raw_logs(spark, sf).withColumn("trace_id", F.concat(F.lit("t-"), (F.col("event_id") * 7 % 4001).cast("string")))
    root = scratch(spark)
    marked = [sinks.append_logs(logs.filter(F.col("event_id") % 3 == b), root, b, order_cols=("timestamp", "event_id")) for b in range(3)]
    stored = sinks.read_table(spark, root, "logs", logs.schema).select("event_id", F.lit(True).alias("stored"))
    rows = reduce(DataFrame.unionByName, marked).join(stored, "event_id", "left")
    return rows.select("event_id", "trace_id", (F.col("event_id") % 3).alias("batch"), "degraded", F.coalesce("stored", F.lit(False)).alias("stored"))


# --- normalisation --------------------------------------------------------

_DOC_MESSAGE = """CASE WHEN doc_id % 50 = 0 THEN repeat('　', 3)
    WHEN doc_id % 13 = 0 THEN concat(text, chr(0))
    WHEN doc_id % 7 = 0 THEN repeat(text, 5) ELSE concat(chr(160), text, chr(10)) END"""


@query("split_valid", f"""
    WITH m AS (SELECT doc_id, {_DOC_MESSAGE} AS message FROM documents),
    t AS (SELECT doc_id, trim(message, {WS_SQL}) AS trimmed FROM m)
    SELECT doc_id, octet_length(encode(trimmed))::BIGINT AS n_bytes,
      CASE WHEN trimmed = '' THEN 'log message is required and cannot be empty'
           WHEN octet_length(encode(trimmed)) > 65536 THEN 'sanitize(message): exceeds max length 65536'
           WHEN contains(trimmed, chr(0)) THEN 'sanitize(message): contains null bytes' END AS reject_reason
    FROM t
""")
def _(spark, sf):
    df = spark.sql(f"SELECT doc_id, {_DOC_MESSAGE} AS message FROM {{documents}}",
                   documents=table(spark, sf, "documents"))
    return normalize.with_reject_reason(df).select(
        "doc_id", F.octet_length(text.trim_text(F.col("message"))).cast("bigint").alias("n_bytes"), "reject_reason")


@query("sanitize_text", f"""
    WITH t AS (SELECT doc_id, concat(chr(7), text, chr(9), chr(127), chr(133), chr(27)) AS dirty FROM documents)
    SELECT doc_id, length(regexp_replace(dirty, {CONTROL_SQL}, '', 'g'))::BIGINT AS n_chars,
      md5(regexp_replace(dirty, {CONTROL_SQL}, '', 'g')) AS clean_md5 FROM t
""")
def _(spark, sf):
    dirty = F.concat(F.lit("\x07"), F.col("text"), F.lit("\t\x7f\x85\x1b"))
    clean = text.sanitize_text(dirty)
    return table(spark, sf, "documents").select(
        "doc_id", F.length(clean).cast("bigint").alias("n_chars"), F.md5(clean.cast("binary")).alias("clean_md5"))


@query("normalize_enums", f"""
    WITH {NORM_CTE}
    SELECT event_id, type, level::BIGINT AS level, origin, boundary, service_id, us,
      us // 1000 AS logical_clock, message FROM norm
""")
def _(spark, sf):
    return us(norm_logs(spark, sf)).select(
        "event_id", "type", F.col("level").cast("bigint").alias("level"), "origin", "boundary", "service_id", "us",
        "logical_clock", "message")


@query("assign_trace_id", f"""
    WITH {RAW_CTE}
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN
      sha256(concat_ws('|', message, boundary, actor_id, type, CAST(level AS VARCHAR), CAST(epoch_us(event_ts) AS VARCHAR)))
      ELSE trace_id END AS trace_id FROM raw
""")
def _(spark, sf):
    logs = raw_logs(spark, sf).withColumn("trace_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("trace_id")))
    return normalize.assign_trace_id(logs).select("event_id", "trace_id")


_MANY = "95 + event_id % 12"


@query("cap_arrays", f"""
    SELECT event_id, least({_MANY}, 100)::BIGINT AS n_tags, least({_MANY}, 100)::BIGINT AS n_resources,
      concat('k', CAST(least({_MANY}, 100) AS VARCHAR)) AS last_key FROM events
""")
def _(spark, sf):
    n = F.lit(95) + F.col("event_id") % 12
    many = table(spark, sf, "events").select("event_id", F.sequence(F.lit(1).cast("bigint"), n).alias("s")).select(
        "event_id",
        F.transform("s", lambda i: F.struct(F.concat(F.lit("k"), i.cast("string")).alias("key"),
                                            F.lit("v").alias("category"))).alias("tags"),
        F.transform("s", lambda i: i.cast("string")).alias("resource_ids"))
    out = normalize.cap_arrays(many)
    return out.select(
        "event_id", F.size("tags").cast("bigint").alias("n_tags"),
        F.size("resource_ids").cast("bigint").alias("n_resources"),
        F.element_at("tags.key", -1).alias("last_key"))


@query("normalize_details", f"""
    WITH e AS (SELECT event_id, 40 + event_id % 20 AS n FROM events),
    kv AS (SELECT event_id, concat('k', lpad(CAST(i AS VARCHAR), 3, '0')) AS k,
             concat('v', chr(7), CAST(event_id AS VARCHAR)) AS v
           FROM (SELECT event_id, unnest(range(1, n + 1)) AS i FROM e)),
    kept AS (SELECT event_id, k, regexp_replace(v, {CONTROL_SQL}, '', 'g') AS v,
               row_number() OVER (PARTITION BY event_id ORDER BY k) AS rn FROM kv)
    SELECT event_id, count(*)::BIGINT AS n_details, max(k) AS last_key, max(v) AS v,
      CASE WHEN event_id % 9 = 0 THEN 'sanitize(details.key): exceeds max length 128' END AS reject_reason
    FROM kept WHERE rn <= 50 GROUP BY event_id
""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.lit(40) + F.col("event_id") % 20).alias("n"))
    entries = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n")), lambda i: F.struct(
        F.concat(F.lit("k"), F.lpad(i.cast("string"), 3, "0")).alias("key"),
        F.concat(F.lit("v\x07"), F.col("event_id").cast("string")).alias("value")))
    df = e.select("event_id", F.map_from_entries(F.reverse(entries)).alias("details"))
    out = normalize.normalize_details(df)
    long_key = F.create_map(F.repeat(F.lit("k"), F.when(F.col("event_id") % 9 == 0, 200).otherwise(5)), F.lit("v"))
    marked = normalize.with_reject_reason(out.select(
        "event_id", F.col("details").alias("kept"), long_key.alias("details"), F.lit("m").alias("message")))
    return marked.select(
        "event_id", F.size("kept").cast("bigint").alias("n_details"), F.array_max(F.map_keys("kept")).alias("last_key"),
        F.array_max(F.map_values("kept")).alias("v"), "reject_reason")


@query("sanitize_input", f"WITH {NORM_CTE} SELECT event_id, input FROM norm")
def _(spark, sf):
    return norm_logs(spark, sf).select("event_id", "input")


# --- validation -----------------------------------------------------------

@query("validate_strict", f"""
    WITH {RAW_CTE}, v AS (
      SELECT event_id,
        CASE WHEN trim(message, {WS_SQL}) = '' THEN 'message'
             WHEN type = 'not-a-type' THEN 'type' WHEN level NOT BETWEEN 1 AND 6 THEN 'level'
             WHEN origin = 'bogus' THEN 'origin' END AS field,
        CASE WHEN trim(message, {WS_SQL}) = '' THEN 'cannot be empty'
             WHEN type = 'not-a-type' THEN 'invalid log type: not-a-type'
             WHEN level NOT BETWEEN 1 AND 6 THEN 'must be integer 1-6'
             WHEN origin = 'bogus' THEN 'invalid origin: bogus' END AS violation
      FROM raw)
    SELECT * FROM v WHERE field IS NOT NULL
""")
def _(spark, sf):
    return validate.validate_strict(raw_logs(spark, sf)).select("event_id", "field", "violation")


@query("validate_strict_all", f"""
    WITH {RAW_CTE}, v AS (
      SELECT event_id, 'message' AS field FROM raw WHERE trim(message, {WS_SQL}) = ''
      UNION ALL SELECT event_id, 'type' FROM raw WHERE type = 'not-a-type'
      UNION ALL SELECT event_id, 'level' FROM raw WHERE level NOT BETWEEN 1 AND 6
      UNION ALL SELECT event_id, 'origin' FROM raw WHERE origin = 'bogus')
    SELECT field, count(*)::BIGINT AS n FROM v GROUP BY field
""")
def _(spark, sf):
    found = validate.validate_strict(raw_logs(spark, sf), first_only=False)
    return found.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("validate_tags", """
    WITH t AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)
    SELECT doc_id, CASE WHEN n > 128 THEN 'sanitize(tags[1].key): exceeds max length 128'
      ELSE 'sanitize(tags[1].category): exceeds max length 1024' END AS tag_problem
    FROM t WHERE n > 128 OR n * 20 > 1024
""")
def _(spark, sf):
    tags = F.array(
        F.struct(F.lit("ok").alias("key"), F.lit("fine").alias("category")),
        F.struct(F.col("text").alias("key"), F.repeat("text", 20).alias("category")))
    df = table(spark, sf, "documents").select("doc_id", tags.alias("tags"))
    return validate.validate_tags(df).select("doc_id", "tag_problem")


@query("allow_lists", f"""
    WITH {RAW_CTE}
    SELECT event_id,
      type IN ('SYSTEM','SECURITY','COMPLIANCE','INFRA','SLA','DEBUG','BUSINESS-AUDIT') AS type_ok,
      origin IN ('SYSTEM','AI_AGENT') AS origin_ok,
      event_id % 2 = 0 AS action_ok FROM raw
""")
def _(spark, sf):
    action = F.when(F.col("event_id") % 2 == 0, "ESCALATE").otherwise("REBOOT")
    return raw_logs(spark, sf).select(
        "event_id", text.is_allowed_type(F.col("type")).alias("type_ok"),
        text.is_allowed_origin(F.col("origin")).alias("origin_ok"), text.is_allowed_action(action).alias("action_ok"))


@query("row_accessors", f"""
    WITH {RAW_CTE}
    SELECT event_id, CASE WHEN tag_ip = '' THEN '0.0.0.0' ELSE tag_ip END AS ip,
      CASE WHEN resource_id = '' THEN 'unknown' ELSE resource_id END AS resource,
      CASE WHEN actor_id = '' THEN 'system' ELSE actor_id END AS actor FROM raw
""")
def _(spark, sf):
    return raw_logs(spark, sf).select(
        "event_id", text.tag_value(F.col("tags"), "ip", "0.0.0.0").alias("ip"),
        text.first_resource(F.col("resource_ids"), "unknown").alias("resource"),
        text.actor_or(F.col("actor_id"), "system").alias("actor"))


# --- masking --------------------------------------------------------------

@query("mask_pii", f"""
    SELECT doc_id, md5({mask_sql('text')}) AS masked_md5, length({mask_sql('text')})::BIGINT AS n_chars FROM documents
""")
def _(spark, sf):
    masked = table(spark, sf, "documents").select("doc_id", pii.mask_pii(F.col("text"), SERVER_SIX).alias("m"))
    return masked.select("doc_id", F.md5(F.col("m").cast("binary")).alias("masked_md5"),
                         F.length("m").cast("bigint").alias("n_chars"))


@query("mask_regex", r"""
    SELECT doc_id, md5(regexp_replace(text, '(?i)\b(\w)(\w*)ing\b', '<\1>$$', 'g')) AS masked_md5 FROM documents
""")
def _(spark, sf):
    masked = table(spark, sf, "documents").select(
        "doc_id", pii.mask_regex(F.col("text"), r"(?i)\b(\w)(\w*)ing\b", "<${1}>$$").alias("m"))
    return masked.select("doc_id", F.md5(F.col("m").cast("binary")).alias("masked_md5"))


@query("mask_keys", f"""
    WITH {RAW_CTE} SELECT event_id, detail_note AS note, '[MASKED_KEY]' AS secret, '[MASKED_KEY]' AS s FROM raw
""")
def _(spark, sf):
    df = raw_logs(spark, sf).select(
        "event_id", pii.mask_keys(F.col("details"), ["secret", "password"]).alias("d"),
        pii.mask_struct_keys(F.struct(F.col("message").alias("s")), ["s"]).alias("st"))
    return df.select("event_id", F.col("d")["note"].alias("note"), F.col("d")["secret"].alias("secret"), "st.s")


@query("mask_log", f"""
    WITH {NORM_CTE}
    SELECT event_id, {mask_sql('message')} AS message, {mask_sql('actor_id')} AS actor_id, {mask_sql('input')} AS input,
      CASE WHEN tag_ip <> '' THEN tag_ip END AS ip, {mask_sql('detail_note')} AS note,
      {mask_sql('detail_secret')} AS secret,
      CASE WHEN origin = 'AI_AGENT' THEN {mask_sql('raw_message')} END AS reasoning,
      CASE WHEN origin = 'AI_AGENT' THEN {mask_sql('detail_note')} END AS back_log
    FROM norm JOIN (SELECT event_id AS rid, message AS raw_message FROM raw) r ON r.rid = norm.event_id
""")
def _(spark, sf):
    r = rules()
    df = masking.mask_log(norm_logs(spark, sf), r.masking_rules, r.preserve_fields)
    return df.select(
        "event_id", "message", "actor_id", "input", F.get("tags.category", F.lit(0)).alias("ip"),
        F.col("details")["note"].alias("note"), F.col("details")["secret"].alias("secret"),
        F.col("ai_context.reasoning_trace").alias("reasoning"),
        F.get("agent_back_log.result", F.lit(0)).alias("back_log"))


@query("mask_pii_client", f"""
    SELECT doc_id, md5({mask_sql('text', CLIENT_ALL, RE2_CLIENT)}) AS masked_md5 FROM documents
""")
def _(spark, sf):
    masked = table(spark, sf, "documents").select(
        "doc_id", pii.mask_pii(F.col("text"), CLIENT_ALL, "client").alias("m"))
    return masked.select("doc_id", F.md5(F.col("m").cast("binary")).alias("masked_md5"))


@query("contains_pii", f"""
    SELECT 'documents' AS source, doc_id AS id, {contains_sql('text')} AS has_pii FROM documents
    UNION ALL SELECT 'conversations', conv_id * 1000 + turn, {contains_sql('text')} FROM conversations
""")
def _(spark, sf):
    hit = pii.contains_pii(F.col("text")).alias("has_pii")
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), hit)
    return docs.unionByName(table(spark, sf, "conversations").select(
        F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), hit))


@query("mask_all_pii", f"""
    SELECT doc_id, md5({mask_sql('text', pii.ALL_ORDER)}) AS masked_md5 FROM documents
""")
def _(spark, sf):
    masked = table(spark, sf, "documents").select("doc_id", pii.mask_all_pii(F.col("text")).alias("m"))
    return masked.select("doc_id", F.md5(F.col("m").cast("binary")).alias("masked_md5"))


@query("register_pattern", r"""
    SELECT event_id, regexp_replace(concat('token-', CAST(event_id AS VARCHAR)), '\btoken-\d+\b', '[MASKED_TOKEN]', 'g') AS m
    FROM events
""")
def _(spark, sf):
    extended = pii.register_pattern("TOKEN", r"\btoken-\d+\b")
    return raw_logs(spark, sf).select(
        "event_id", pii.mask_pii(F.col("details")["secret"], ["TOKEN"], extended).alias("m"))


def _policy_sql(col: str, preserve: str | None = None) -> str:
    """Masking by the three policies in order, else the default rules."""
    strict = mask_sql("c", ["EMAIL"])
    strict = rf"regexp_replace({strict}, '(10)\.0\.(\d+)', '\1.x.\2', 'g')"
    high = mask_sql("c", ["PHONE", "CREDIT_CARD"])
    agent = mask_sql("c", ["GOVERNMENT_ID"])
    e0 = col
    e1 = f"CASE WHEN p1 THEN {strict.replace('(c,', '(' + e0 + ',')} ELSE {e0} END"
    e2 = f"CASE WHEN p2 THEN {high.replace('(c,', '(' + e1 + ',')} ELSE {e1} END"
    e3 = f"CASE WHEN p3 THEN {agent.replace('(c,', '(' + e2 + ',')} ELSE {e2} END"
    body = f"CASE WHEN p1 OR p2 OR p3 THEN {e3} ELSE {mask_sql(col)} END"
    return f"CASE WHEN {preserve} THEN {col} ELSE {body} END" if preserve else body


@query("mask_with_policies", f"""
    WITH {NORM_CTE}, p AS (
      SELECT *, type = 'SECURITY' AS p1, level >= 4 AS p2, origin = 'AI_AGENT' AND level <= 3 AS p3 FROM norm)
    SELECT event_id, {_policy_sql('message')} AS message, {_policy_sql('actor_id', 'p1')} AS actor_id,
      {_policy_sql('input')} AS input, CASE WHEN tag_ip <> '' THEN tag_ip END AS ip,
      {_policy_sql('detail_note', 'p3')} AS note
    FROM p
""")
def _(spark, sf):
    r = rules()
    df = masking.mask_with_policies(norm_logs(spark, sf), r.masking_policies, r.masking_rules, r.preserve_fields)
    return df.select("event_id", "message", "actor_id", "input", F.get("tags.category", F.lit(0)).alias("ip"),
                     F.col("details")["note"].alias("note"))


def _leak_sql(fields: str) -> str:
    found = " UNION ALL ".join(
        f"SELECT id, field_name, '{c}' AS category, regexp_extract(value, '{p}', 0) AS snippet FROM f "
        f"WHERE regexp_matches(value, '{p}')" for c, p in RE2.items())
    return f"""{fields}, hits AS ({found})
    SELECT id, field_name, category, CASE WHEN octet_length(encode(snippet)) > 50
      THEN concat(decode(encode(snippet)[1:50]), '...') ELSE snippet END AS snippet FROM hits"""


@query("pii_leaks", _leak_sql(f"""
    WITH {NORM_CTE}, f AS (
      SELECT event_id AS id, 'message' AS field_name, message AS value FROM norm
      UNION ALL SELECT event_id, 'actorId', actor_id FROM norm
      UNION ALL SELECT event_id, 'input', input FROM norm
      UNION ALL SELECT event_id, 'tags[ip]', tag_ip FROM norm
      UNION ALL SELECT event_id, 'details[note]', detail_note FROM norm
      UNION ALL SELECT event_id, 'details[secret]', detail_secret FROM norm
      UNION ALL SELECT norm.event_id, 'aiContext.reasoningTrace', raw.message FROM norm JOIN raw USING (event_id)
                WHERE norm.origin = 'AI_AGENT'
      UNION ALL SELECT event_id, 'agentBackLog[0].result', detail_note FROM norm WHERE origin = 'AI_AGENT')"""))
def _(spark, sf):
    return masking.pii_leaks(norm_logs(spark, sf).withColumnRenamed("event_id", "id"), keep=("id",))


@query("pii_leaks_documents", _leak_sql("WITH f AS (SELECT doc_id AS id, 'text' AS field_name, text AS value FROM documents)"))
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("field_name"), "text")
    return masking.text_leaks(docs, "text").drop("text")


@query("remask_leaks", f"""
    WITH {NORM_CTE}
    SELECT event_id, {mask_sql(mask_sql('message', ['EMAIL']), pii.ALL_ORDER)} AS message,
      {mask_sql('actor_id', ['EMAIL'])} AS actor_id,
      {mask_sql(mask_sql('input', ['EMAIL']), pii.ALL_ORDER)} AS input
    FROM norm
""")
def _(spark, sf):
    once = masking.mask_log(norm_logs(spark, sf), [MaskRule("PII_TYPE", category="EMAIL")])
    return masking.remask_leaks(once, ["actorId"]).select("event_id", "message", "actor_id", "input")


@query("mask_nested", f"""
    WITH {NORM_CTE}
    SELECT event_id, {mask_sql('message')} AS a, detail_note AS kept, '[MASKED_KEY]' AS secret,
      {mask_sql('input')} AS deep FROM norm
""")
def _(spark, sf):
    nested = F.struct(
        F.col("message").alias("a"),
        F.struct(F.col("details")["note"].alias("note"), F.col("details")["secret"].alias("secret")).alias("b"),
        F.array(F.create_map(F.lit("x"), F.col("input"))).alias("c"))
    df = norm_logs(spark, sf).select("event_id", nested.alias("n"))
    keyed = [*six_rules(), MaskRule("KEY_MATCH", keys=("secret",))]
    out = masking.mask_nested(df, ["n"], keyed, preserve=("note",))
    return out.select("event_id", F.col("n.a").alias("a"), F.col("n.b.note").alias("kept"),
                      F.col("n.b.secret").alias("secret"), F.col("n.c")[0]["x"].alias("deep"))


@query("mask_json_text", f"""
    WITH {NORM_CTE}
    SELECT event_id, {mask_sql('message')} AS a, detail_note AS note, {mask_sql('input')} AS first FROM norm
""")
def _(spark, sf):
    js = F.to_json(F.struct(F.col("message").alias("a"), F.struct(F.col("details")["note"].alias("note")).alias("b"),
                            F.array("input").alias("c")))
    run = masking.json_leaves_masker(SERVER_SIX, preserve=("note",))
    out = norm_logs(spark, sf).select("event_id", run(js).alias("j"))
    parsed = F.from_json("j", "a string, b struct<note:string>, c array<string>")
    return out.select("event_id", parsed.alias("p")).select(
        "event_id", "p.a", F.col("p.b.note").alias("note"), F.col("p.c")[0].alias("first"))

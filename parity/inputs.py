"""Logs derived from the given ``events`` table, the same way in Spark and SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.operators.normalize import normalize, split_valid
from logwarden.plans.sizing import checkpoint_dir, spread_small
from logwarden.schemas import AI_CONTEXT, BACK_LOG_ENTRY, LOG_SCHEMA

SERVICE = "demo-service"

RAW_SQL = """
SELECT
  event_id,
  ts AS event_ts,
  concat('ev-', CAST(event_id AS STRING)) AS trace_id,
  concat('client-', CAST(user_id % 5 AS STRING)) AS client_id,
  CASE event_type WHEN 'error' THEN 'SECURITY' WHEN 'purchase' THEN 'COMPLIANCE'
       WHEN 'click' THEN 'SLA' WHEN 'signup' THEN 'BUSINESS-AUDIT' ELSE 'not-a-type' END AS type,
  CASE WHEN value >= 200 THEN 6 WHEN value >= 100 THEN 5 WHEN value >= 50 THEN 4
       WHEN value >= 20 THEN 3 WHEN value >= 5 THEN 2 WHEN value >= 1 THEN 1 ELSE 0 END AS level,
  value >= 250 AS is_critical,
  CASE WHEN event_id % 20 = 0 THEN 'AI_AGENT' WHEN event_id % 20 = 1 THEN 'bogus' ELSE 'SYSTEM' END AS origin,
  CASE WHEN event_id % 10 = 3 THEN '' ELSE concat('svc-', CAST(user_id % 7 AS STRING)) END AS boundary,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('user', CAST(user_id AS STRING), '@example.com') END AS actor_id,
  CASE WHEN event_type = 'error' AND event_id % 4 <> 0
       THEN concat('10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 256 AS STRING)) ELSE '' END AS tag_ip,
  CASE WHEN event_id % 3 = 0 THEN concat('doc-', CAST(event_id AS STRING)) ELSE '' END AS resource_id,
  CASE WHEN event_id % 97 = 0 THEN '   '
       WHEN event_id % 11 = 0 THEN concat('  card 4111-1111-1111-1111 seen, props=', props)
       WHEN event_id % 11 = 1 THEN 'Policy VIOLATION by admin@example.com'
       WHEN event_id % 11 = 2 THEN 'call 090-1234-5678 now'
       WHEN event_id % 11 = 3 THEN '番号123456789012です'
       WHEN event_id % 11 = 4 THEN 'brute  force from 10.0.0.1'
       ELSE concat(event_type, ' by user ', CAST(user_id AS STRING)) END AS message,
  CASE WHEN event_id % 7 = 0 THEN concat('tel 090-1234-', lpad(CAST(event_id % 10000 AS STRING), 4, '0'), chr(7), '!')
       ELSE props END AS input,
  concat('mail user', CAST(user_id AS STRING), '@example.com') AS detail_note,
  concat('token-', CAST(event_id AS STRING)) AS detail_secret,
  CAST(event_id % 8 AS INT) AS loop_depth
FROM events
"""

# White_Space characters as SQL, and control characters dropped.
WS_SQL = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(133)||chr(160)||chr(5760)||"
    + "||".join(f"chr({c})" for c in range(8192, 8203))
    + "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)
CONTROL_SQL = r"'[\x00-\x08\x0B-\x1F\x{7F}-\x{9F}]'"

NORM_COLUMNS = f"""
  event_id, event_ts, epoch_us(event_ts) AS us, trace_id, client_id,
  CASE WHEN type IN ('SYSTEM','SECURITY','COMPLIANCE','INFRA','SLA','DEBUG','BUSINESS-AUDIT')
       THEN type ELSE 'SYSTEM' END AS type,
  CASE WHEN level BETWEEN 1 AND 6 THEN level ELSE 3 END AS level,
  is_critical,
  CASE WHEN origin IN ('SYSTEM','AI_AGENT') THEN origin ELSE 'SYSTEM' END AS origin,
  CASE WHEN boundary = '' THEN 'unknown' ELSE boundary END AS boundary,
  '{SERVICE}' AS service_id,
  actor_id, tag_ip, resource_id,
  regexp_replace(trim(message, {WS_SQL}), {CONTROL_SQL}, '', 'g') AS message,
  regexp_replace(input, {CONTROL_SQL}, '', 'g') AS input,
  detail_note, detail_secret, loop_depth
"""

RAW_CTE = f"raw AS ({RAW_SQL})"
NORM_CTE = f"{RAW_CTE}, norm AS (SELECT {NORM_COLUMNS} FROM raw WHERE trim(message, {WS_SQL}) <> '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_small(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark) -> str:
    """A fresh folder in the shared checkpoint folder; a local one only in local mode, where none is named."""
    base = checkpoint_dir(spark)
    if base is None and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="lw-")


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log records with their nested columns; every row of ``events``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    flat = spark.sql(RAW_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return with_nested(flat)


def with_nested(flat: DataFrame) -> DataFrame:
    ts = F.col("event_ts").cast("timestamp")
    agent = F.col("origin") == "AI_AGENT"
    ai = F.struct(
        F.lit("agent-1").alias("agent_id"), F.lit("").alias("task_id"), F.col("loop_depth").alias("loop_depth"),
        F.lit("m1").alias("model"), F.lit(0.5).alias("confidence"), F.col("message").alias("reasoning_trace"))
    entry = F.struct(
        F.lit("agent-1").alias("agent_id"), F.lit("look").alias("action"), ts.alias("timestamp"),
        F.col("detail_note").alias("result"), F.lit("success").alias("status"))
    tags = F.array(F.struct(F.lit("ip").alias("key"), F.col("tag_ip").alias("category")))
    return flat.select(
        "event_id", "client_id", "trace_id", "actor_id", "type", F.col("level").cast("int").alias("level"),
        ts.alias("timestamp"), F.lit(None).cast("bigint").alias("logical_clock"), "boundary", "origin",
        "is_critical", "message",
        F.when(F.col("tag_ip") != "", tags).otherwise(F.array().cast(tags_type())).alias("tags"),
        F.when(F.col("resource_id") != "", F.array("resource_id"))
        .otherwise(F.array().cast("array<string>")).alias("resource_ids"),
        F.when(agent, ai).cast(AI_CONTEXT).alias("ai_context"),
        F.when(agent, F.array(entry)).cast(LOG_SCHEMA["agent_back_log"].dataType).alias("agent_back_log"),
        "input",
        F.create_map(F.lit("note"), F.col("detail_note"), F.lit("secret"), F.col("detail_secret")).alias("details"),
    )


def tags_type():
    return LOG_SCHEMA["tags"].dataType


def norm_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid, normalised logs."""
    return normalize(split_valid(raw_logs(spark, sf_dir))[0], SERVICE)


def us(df: DataFrame, column: str = "timestamp", out: str = "us") -> DataFrame:
    return df.withColumn(out, F.unix_micros(column))


__all__ = ["BACK_LOG_ENTRY", "NORM_CTE", "RAW_CTE", "RAW_SQL", "SERVICE", "norm_logs", "raw_logs", "scratch", "table", "us"]

"""Schemas and fixed value lists of the log domain."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed vocabularies of the log domain.
LOG_TYPES = ("SYSTEM", "SECURITY", "COMPLIANCE", "INFRA", "SLA", "DEBUG", "BUSINESS-AUDIT")
ORIGINS = ("SYSTEM", "AI_AGENT")
ACTION_TYPES = (
    "AI_ANALYZE",
    "AUTOMATED_REMEDIATE",
    "SYSTEM_NOTIFICATION",
    "EXTERNAL_WEBHOOK",
    "KILL_SWITCH",
    "ESCALATE",
)
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
PRIORITIES = ("LOW", "MEDIUM", "HIGH")
MIN_LEVEL, MAX_LEVEL, DEFAULT_LEVEL = 1, 6, 3

# Size limits.
MAX_TEXT_BYTES = 65536
MAX_TAGS = 100
MAX_TAG_KEY_BYTES = 128
MAX_TAG_VALUE_BYTES = 1024
MAX_RESOURCE_IDS = 100
MAX_DETAILS = 50

TAG = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("category", T.StringType()),
])

AI_CONTEXT = T.StructType([
    T.StructField("agent_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("loop_depth", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reasoning_trace", T.StringType()),
])

BACK_LOG_ENTRY = T.StructType([
    T.StructField("agent_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("result", T.StringType()),
    T.StructField("status", T.StringType()),
])

LOG_SCHEMA = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("parent_span_id", T.StringType()),
    T.StructField("actor_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("logical_clock", T.LongType()),
    T.StructField("boundary", T.StringType()),
    T.StructField("service_id", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("is_critical", T.BooleanType()),
    T.StructField("message", T.StringType()),
    T.StructField("tags", T.ArrayType(TAG)),
    T.StructField("resource_ids", T.ArrayType(T.StringType())),
    T.StructField("previous_hash", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("ai_context", AI_CONTEXT),
    T.StructField("agent_back_log", T.ArrayType(BACK_LOG_ENTRY)),
    T.StructField("input", T.StringType()),
    T.StructField("trigger_agent", T.BooleanType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
])

# One nullable struct for every payload kind; ``kind`` says which fields are set.
PAYLOAD = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("error_details", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("rule_ref", T.StringType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("metric_key", T.StringType()),
    T.StructField("baseline", T.DoubleType()),
    T.StructField("observed", T.DoubleType()),
    T.StructField("deviation_pct", T.DoubleType()),
])

DETECTION = T.StructType([
    T.StructField("rule_pos", T.IntegerType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("payload", PAYLOAD),
])

EXEC_PARAMS = T.StructType([
    T.StructField("target_endpoint", T.StringType()),
    T.StructField("script_identifier", T.StringType()),
    T.StructField("notification_channel", T.StringType()),
    T.StructField("prompt_template", T.StringType()),
])

GUARDRAILS = T.StructType([
    T.StructField("require_human_approval", T.BooleanType()),
    T.StructField("timeout_ms", T.IntegerType()),
    T.StructField("max_retries", T.IntegerType()),
])

TASK_RULE = T.StructType([
    T.StructField("rule_pos", T.IntegerType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("execution_level", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("exec_params", EXEC_PARAMS),
    T.StructField("guardrails", GUARDRAILS),
])

CHAIN_STEP = T.StructType([
    T.StructField("step_order", T.IntegerType()),
    T.StructField("role", T.StringType()),
    T.StructField("required", T.BooleanType()),
])

ROUTING_RULE = T.StructType([
    T.StructField("rule_pos", T.IntegerType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("min_level", T.IntegerType()),
    T.StructField("max_level", T.IntegerType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("chain", T.ArrayType(CHAIN_STEP)),
])

RESPONSE_RULE = T.StructType([
    T.StructField("rule_pos", T.IntegerType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("block_action", T.StringType()),
    T.StructField("analysis_prompt", T.StringType()),
    T.StructField("min_priority", T.StringType()),
    T.StructField("notify_targets", T.ArrayType(T.StringType())),
])

PERMISSION = T.StructType([
    T.StructField("allowed_log_types", T.ArrayType(T.StringType())),
    T.StructField("denied_log_types", T.ArrayType(T.StringType())),
    T.StructField("max_log_level", T.IntegerType()),
    T.StructField("can_write", T.BooleanType()),
    T.StructField("can_read", T.BooleanType()),
    T.StructField("can_approve", T.BooleanType()),
    T.StructField("can_admin", T.BooleanType()),
])

ANALYSIS = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("indicators", T.ArrayType(T.StringType())),
    T.StructField("recommended", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("tokens_used", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

INFERENCE = T.StructType([
    T.StructField("thought", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("model", T.StringType()),
    T.StructField("tokens_used", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

CHAIN_HEADS = T.StructType([
    T.StructField("service_id", T.StringType()), T.StructField("boundary", T.StringType()),
    T.StructField("chain_date", T.StringType()), T.StructField("chain_lane", T.IntegerType()),
    T.StructField("n_rows", T.LongType()), T.StructField("head_hash", T.StringType()),
])

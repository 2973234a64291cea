"""Reject what cannot be logged, complete the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import content_id
from ..functions.text import (
    cut_bytes,
    is_allowed_type,
    sanitize_text,
    text,
    text_problem,
    trim_text,
)
from ..schemas import (
    DEFAULT_LEVEL,
    LOG_SCHEMA,
    MAX_DETAILS,
    MAX_LEVEL,
    MAX_RESOURCE_IDS,
    MAX_TAG_KEY_BYTES,
    MAX_TAGS,
    MAX_TEXT_BYTES,
    MIN_LEVEL,
    ORIGINS,
)

EMPTY_MESSAGE = "log message is required and cannot be empty"


def conform(df: DataFrame) -> DataFrame:
    """Add the log columns that are missing, as typed nulls."""
    have = set(df.columns)
    return df.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in LOG_SCHEMA.fields if f.name not in have}
    )


def first_details(m: Column) -> Column:
    """The first 50 entries by key."""
    entries = F.slice(F.sort_array(F.map_entries(m)), 1, MAX_DETAILS)
    return F.when(F.size(m) > MAX_DETAILS, F.map_from_entries(entries)).otherwise(m)


def reject_reason(df: DataFrame) -> Column:
    """Null for an acceptable row; message first, then the detail keys."""
    trimmed = trim_text(text("message"))
    reason = F.coalesce(F.when(trimmed == "", F.lit(EMPTY_MESSAGE)), text_problem(trimmed, "message"))
    if "details" in df.columns:
        problems = F.transform(
            F.sort_array(F.map_keys(first_details(F.col("details")))),
            lambda k: text_problem(k, "details.key", MAX_TAG_KEY_BYTES),
        )
        # Almost no row has a bad key: one look at the keys as they are comes first.
        suspect = F.exists(F.map_keys("details"), lambda k: text_problem(k, "details.key", MAX_TAG_KEY_BYTES).isNotNull())
        bad_key = F.when(suspect, F.get(F.filter(problems, lambda p: p.isNotNull()), F.lit(0)))
        reason = F.coalesce(reason, bad_key)
    return reason


def with_reject_reason(df: DataFrame) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(df))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the reason column, rejected rows with it)."""
    marked = with_reject_reason(df)
    return (
        marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.filter(F.col("reject_reason").isNotNull()),
    )


def normalize_message(df: DataFrame) -> DataFrame:
    """Trim first, then drop control characters: blanks freed by that stay."""
    return df.withColumn("message", sanitize_text(trim_text(text("message"))))


def normalize_enums(df: DataFrame, service_id: str, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    ts = F.coalesce(F.col("timestamp"), now)
    level = F.col("level")
    return df.withColumns({
        "type": F.when(is_allowed_type(F.col("type")), F.col("type")).otherwise("SYSTEM"),
        "level": F.when(level.between(MIN_LEVEL, MAX_LEVEL), level).otherwise(F.lit(DEFAULT_LEVEL)).cast("int"),
        "origin": F.when(F.col("origin").isin(*ORIGINS), F.col("origin")).otherwise("SYSTEM"),
        "boundary": F.coalesce(F.nullif(F.col("boundary"), F.lit("")), F.lit("unknown")),
        "service_id": F.lit(service_id),
        "timestamp": ts,
        "logical_clock": F.coalesce(F.nullif(F.col("logical_clock"), F.lit(0)), F.unix_millis(ts)).cast("bigint"),
        "tags": F.coalesce(F.col("tags"), F.array().cast(LOG_SCHEMA["tags"].dataType)),
        "is_critical": F.coalesce(F.col("is_critical"), F.lit(False)),
        "trigger_agent": F.coalesce(F.col("trigger_agent"), F.lit(False)),
        **{c: text(c) for c in ("actor_id", "span_id", "parent_span_id", "input",
                                "previous_hash", "hash", "signature")},
    })


def assign_trace_id(df: DataFrame, random: bool = False, nth: Column | None = None) -> DataFrame:
    """Give blank trace ids a value; from the content, so that a retry agrees.

    ``nth``, a number that no two rows share, tells equal records without an id apart.
    """
    made = F.uuid() if random else content_id(
        text("message"), text("boundary"), text("actor_id"), text("type"),
        F.col("level").cast("string"), F.unix_micros("timestamp").cast("string"),
        *([] if nth is None else [nth.cast("string")]),
    )
    return df.withColumn("trace_id", F.coalesce(F.nullif(F.col("trace_id"), F.lit("")), made))


def cap_arrays(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "tags": F.slice("tags", 1, MAX_TAGS),
        "resource_ids": F.slice("resource_ids", 1, MAX_RESOURCE_IDS),
    })


def normalize_details(df: DataFrame) -> DataFrame:
    kept = first_details(F.col("details"))
    return df.withColumn(
        "details", F.transform_values(kept, lambda k, v: sanitize_text(cut_bytes(v, MAX_TEXT_BYTES)))
    )


def sanitize_input(df: DataFrame) -> DataFrame:
    return df.withColumn("input", sanitize_text(text("input")))


def normalize(df: DataFrame, service_id: str, now: Column | None = None, nth: Column | None = None) -> DataFrame:
    """All of the above for rows that passed ``split_valid``; one narrow stage."""
    df = normalize_message(conform(df))
    df = normalize_enums(df, service_id, now)
    return sanitize_input(normalize_details(cap_arrays(assign_trace_id(df, nth=nth))))

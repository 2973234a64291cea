"""Lookups over stored tables.

A lookup by id is an equality that reaches the Parquet reader.  ``sinks.append_table`` sorts the
tables by their id and writes Bloom filters, so of all files only the footers are read,
and of row groups only those that may have the id.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text

DEFAULT_LIMIT = 50


def _by(df: DataFrame, column: str, value: str | Column) -> DataFrame:
    return df.filter(F.col(column) == value)


def log_by_trace(logs: DataFrame, trace_id: str | Column) -> DataFrame:
    return _by(logs, "trace_id", trace_id)


def task_by_id(tasks: DataFrame, task_id: str | Column) -> DataFrame:
    return _by(tasks, "task_id", task_id)


def approval_by_task(approvals: DataFrame, task_id: str | Column) -> DataFrame:
    return _by(approvals, "task_id", task_id)


def block_by_id(blocks: DataFrame, block_id: str | Column) -> DataFrame:
    return _by(blocks, "block_id", block_id)


def _filtered(tasks: DataFrame, event: str, status: str, start: datetime | None, end: datetime | None) -> DataFrame:
    if event:
        tasks = tasks.filter(F.col("event_name") == event)
    if status:
        tasks = tasks.filter(F.col("status") == status)
    if start is not None:
        tasks = tasks.filter(F.col("created_at") >= F.lit(start))
    if end is not None:
        tasks = tasks.filter(F.col("created_at") <= F.lit(end))
    return tasks


def list_tasks(
    tasks: DataFrame, event: str = "", status: str = "", start: datetime | None = None, end: datetime | None = None,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    """A page of tasks, newest first, with the total number of matches in ``total``.

    The page is a top-k per partition, the total a scalar subquery: no window
    over all rows.
    """
    matching = _filtered(tasks, event, status, start, end)
    total = matching.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = matching.orderBy(F.col("created_at").desc(), "task_id").offset(offset).limit(
        limit if limit > 0 else DEFAULT_LIMIT)
    return page.withColumn("total", total)


def threat_responses_by_trace(responses: DataFrame, trace_id: str | Column) -> DataFrame:
    return _by(responses, "trace_id", trace_id).orderBy("created_at", "response_id")


def pending_blocks(blocks: DataFrame) -> DataFrame:
    """Oldest first; a missing resolver is blank."""
    out = blocks.filter(F.col("status") == "pending")
    if "resolved_by" in blocks.columns:
        out = out.withColumn("resolved_by", text("resolved_by"))
    return out.orderBy("created_at", "block_id")

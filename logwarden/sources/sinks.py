"""Append-only tables as Parquet, partitioned by event date.

Every write carries a batch id and goes to a folder of its own, so repeating a
batch replaces what its first attempt left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.crypto import content_id
from ..functions.text import text, utc_date
from ..plans.sizing import broadcast_if_small
from . import id_index

DATE = "event_date"
BATCH = "batch_id"
ROW_ID = "row_id"

# The append-only tables and the column that dates their rows.
TABLES = {
    "logs": "timestamp",
    "detections": "timestamp",
    "tasks": "created_at",
    "task_results": "dispatched_at",
    "approvals": "requested_at",
    "approval_steps": "created_at",
    "task_modifications": "created_at",
    "threat_responses": "created_at",
    "pending_blocks": "created_at",
    "outbox": "created_at",
    "late_logs": "timestamp",
}


# The id by which single rows of a table are looked up.
LOOKUP = {"logs": "trace_id", "tasks": "task_id", "approvals": "task_id", "pending_blocks": "block_id"}


def indexed(column: str) -> dict[str, str]:
    """Parquet options: a Bloom filter of the ids of every row group, sized by how many there are."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def append_table(
    df: DataFrame, root: str, table: str, batch_id: int | str, date_from: str | None = None, rebalance: bool = True,
) -> None:
    """Append one batch; writing the same batch id again replaces it.

    Rows are rebalanced by date first: a date gets as many files as its size
    needs, a busy date is split, and no task writes a file for every date.
    Tables with a lookup id are sorted by it inside their files and have Bloom filters, so
    a lookup reads the pages that may have the id and no row group that cannot.
    """
    dated = df.withColumn(DATE, utc_date(F.col(date_from or TABLES[table])))
    if rebalance:
        dated = dated.hint("rebalance", F.col(DATE))
    column = LOOKUP.get(table)
    if column in dated.columns:
        dated = dated.sortWithinPartitions(DATE, column)
    writer = dated.write.mode("overwrite").options(**(indexed(column) if column in dated.columns else {}))
    writer.partitionBy(DATE).parquet(f"{table_path(root, table)}/{BATCH}={batch_id}")


def read_table(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """All batches of a table; with a schema given, an absent table is empty."""
    reader = spark.read.option("basePath", table_path(root, table))
    if schema is None:
        return reader.parquet(table_path(root, table))
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType()), T.StructField(DATE, T.DateType())])
    try:
        return reader.schema(full).parquet(table_path(root, table))
    except AnalysisException:
        return spark.createDataFrame([], full)


def batch_table(spark: SparkSession, root: str, table: str, batch_id: int | str, schema: T.StructType) -> DataFrame | None:
    """What one batch wrote to a table; None if it wrote nothing yet."""
    try:
        return spark.read.schema(schema).parquet(f"{table_path(root, table)}/{BATCH}={batch_id}").select(*schema.fieldNames())
    except AnalysisException:
        return None


def mark_duplicates(
    logs: DataFrame, stored_ids: DataFrame | None = None, order_cols: Sequence[str] = ("timestamp",),
    id_col: str = "trace_id",
) -> DataFrame:
    """Add ``degraded`` and ``warning``: a trace id that is stored or repeated.

    The first row of a trace id by ``order_cols`` is good.  Only ids that occur
    more than once are looked up again, and their first row comes from partial
    aggregates, so one id repeated very often does not land in one task.
    ``order_cols`` must tell the rows of a trace apart.
    """
    order = F.struct(*order_cols)
    repeated = logs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")).filter(
        F.col("_n") > 1).select(F.col(id_col).alias("_rid"), "_first")
    out = logs.join(repeated, F.col(id_col) == F.col("_rid"), "left")
    bad = F.col("_first").isNotNull() & (order != F.col("_first"))
    if stored_ids is not None:
        # Of the stored ids only those of this batch are carried on.
        mine = broadcast_if_small(logs.select(id_col))
        known = stored_ids.select(id_col).join(mine, id_col, "left_semi").distinct().select(
            F.col(id_col).alias("_sid"), F.lit(True).alias("_stored"))
        out = out.join(known, F.col(id_col) == F.col("_sid"), "left")
        bad = bad | F.col("_stored").isNotNull()
    warning = F.concat(F.lit("log persistence failed: duplicate trace id "), F.col(id_col))
    return out.withColumn("degraded", bad).withColumn(
        "warning", F.when(F.col("degraded"), warning).otherwise("")).drop("_rid", "_first", "_sid", "_stored")


def row_id(batch_id: int | str) -> Column:
    """The identity of a row of a written batch: where it stands in the files.

    Many logs can share a trace id.  The number of the task that wrote the file counts, not
    the random part of its name, so the same rows written in the same order get the same ids.
    """
    file = F.col("_metadata.file_path")
    place = [F.regexp_extract(file, r"([^/]*)/part-(\d+)-", 1), F.regexp_extract(file, r"([^/]*)/part-(\d+)-", 2),
             F.regexp_extract(file, r"\.c(\d+)\.", 1)]
    return content_id(F.lit(str(batch_id)), *place, F.col("_metadata.row_index").cast("string"))


def staged_logs(spark: SparkSession, root: str, batch_id: int | str, table: str = "logs") -> DataFrame:
    """All rows of one batch as they were before uniqueness was tested, each with a ``row_id``."""
    staged = spark.read.parquet(f"{table_path(root, table + '_staged')}/{BATCH}={batch_id}").drop(DATE)
    return staged if ROW_ID in staged.columns else staged.withColumn(ROW_ID, row_id(batch_id))


def append_logs(
    logs: DataFrame, root: str, batch_id: int | str, strict: bool = False, order_cols: Sequence[str] = ("timestamp",),
    table: str = "logs", lookback_days: int | None = None, stored: DataFrame | None = None,
) -> DataFrame:
    """Store the rows with new trace ids; return all rows marked good or degraded.

    The batch is written to a staging table first: what follows does not compute
    it again, and the position in its files tells equal records apart.
    They have a ``row_id`` then, made here unless ``logs`` has it.  ``strict`` raises instead when any row is refused.  ``lookback_days`` looks
    for stored trace ids only in the days before the batch; without it all days
    are searched, through the index of ids that every batch adds to.  ``stored`` gives the rows to search instead.
    """
    spark = logs.sparkSession
    # Chained logs are grouped by day already.
    append_table(logs, root, table + "_staged", batch_id, TABLES["logs"], rebalance=False)
    staged = staged_logs(spark, root, batch_id, table)
    staged = staged.select(
        *logs.columns, *([] if ROW_ID in logs.columns else [ROW_ID]), "_metadata.file_path", "_metadata.row_index")
    where = table_path(root, table)
    if stored is None and lookback_days is None:
        stored = id_index.known_ids(staged, where, batch_id, "trace_id")
        # Batches that were written before there was an index are read.
        old = set(id_index.batches_of(spark, where)) - id_index.indexed_batches(spark, where) - {str(batch_id)}
        if old:
            stored = stored.unionByName(read_table(spark, root, table, logs.schema).filter(F.col(BATCH).isin(*old)).select("trace_id"))
    elif stored is None:
        stored = read_table(spark, root, table, logs.schema).filter(F.col(BATCH) != str(batch_id))
    if lookback_days is not None:
        oldest = staged.agg(F.date_sub(F.min(utc_date(F.col(TABLES["logs"]))), lookback_days)).first()[0]
        stored = stored.filter(F.col(DATE) >= F.lit(oldest)) if oldest else stored
    marked = mark_duplicates(
        staged, stored.select("trace_id"), (*order_cols, "file_path", "row_index")).drop("file_path", "row_index")
    if strict and not marked.filter("degraded").isEmpty():
        raise RuntimeError("persist log: duplicate trace id")
    append_table(marked.filter(~F.col("degraded")).drop("degraded", "warning"), root, table, batch_id)
    id_index.write_index(
        batch_table(spark, root, table, batch_id, T.StructType([logs.schema["trace_id"]])), where, batch_id, "trace_id")
    return marked


def task_rows(tasks: DataFrame) -> DataFrame:
    """The stored form of tasks: parameters and guardrails as JSON text."""
    p, g = F.col("exec_params"), F.col("guardrails")
    return tasks.select(
        "task_id", "rule_id", "event_name", "severity", "action_type", "execution_level", "priority", "description",
        F.to_json(F.struct(
            text(p["target_endpoint"]).alias("TargetEndpoint"), text(p["script_identifier"]).alias("ScriptIdentifier"),
            text(p["notification_channel"]).alias("NotificationChannel"),
            text(p["prompt_template"]).alias("PromptTemplate"))).alias("exec_params_json"),
        F.to_json(F.struct(
            g["require_human_approval"].alias("RequireHumanApproval"), g["timeout_ms"].alias("TimeoutMs"),
            g["max_retries"].alias("MaxRetries"))).alias("guardrails_json"),
        "source_trace_id", "source_message", "source_boundary", "source_level", "source_timestamp", "status",
        F.col("error").alias("error_message") if "error" in tasks.columns else F.lit("").alias("error_message"),
        "created_at", F.col("created_at").alias("updated_at"),
    )


def append_tasks(tasks: DataFrame, root: str, batch_id: int | str) -> None:
    append_table(task_rows(tasks), root, "tasks", batch_id)

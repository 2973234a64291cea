"""Log sources and the JSON-text form of nested columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import AI_CONTEXT, BACK_LOG_ENTRY, LOG_SCHEMA, TAG

# Nested column -> its column of JSON text, with the type to decode to.
JSON_COLUMNS: dict[str, tuple[str, T.DataType]] = {
    "tags": ("tags_json", T.ArrayType(TAG)),
    "resource_ids": ("resource_ids_json", T.ArrayType(T.StringType())),
    "ai_context": ("ai_context_json", AI_CONTEXT),
    "agent_back_log": ("agent_back_log_json", T.ArrayType(BACK_LOG_ENTRY)),
    "details": ("details_json", T.MapType(T.StringType(), T.StringType())),
}

# Timestamps inside JSON keep their microseconds.
JSON_WRITE = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _arrival(df: DataFrame) -> DataFrame:
    """Event time where there is one, else the time of reading."""
    return df.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp()))


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Batch source with a fixed schema: no inference, columns pruned at the scan."""
    return _arrival(spark.read.schema(LOG_SCHEMA).format(fmt).options(**options).load(path))


def read_logs_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return _arrival(spark.readStream.schema(LOG_SCHEMA).format(fmt).options(**options).load(path))


def read_logs_kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """JSON log records from a topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).options(**options).load()
    )
    return _arrival(parse_records(raw.select(F.col("value").cast("string").alias("value"))))


def parse_records(df: DataFrame, column: str = "value") -> DataFrame:
    """One JSON record per row to log columns."""
    return df.select(F.from_json(column, LOG_SCHEMA).alias("_log")).select("_log.*")


def split_malformed(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(log columns of the records that parse, the other rows as they came with ``parse_error``).

    A record with a value of the wrong type, or that is no JSON object at all, keeps its text.
    """
    whole = T.StructType([*LOG_SCHEMA.fields, T.StructField("_malformed", T.StringType())])
    read = df.withColumn("_log", F.from_json(column, whole, {"columnNameOfCorruptRecord": "_malformed"}))
    object_like = F.startswith(F.ltrim(F.coalesce(column, F.lit(""))), F.lit("{"))
    bad = F.coalesce(F.col("_log._malformed").isNotNull(), F.lit(True)) | ~object_like
    reason = F.when(object_like, "record does not fit the log schema").otherwise("record is no JSON object")
    return (
        read.filter(~bad).select(*[F.col("_log")[f.name].alias(f.name) for f in LOG_SCHEMA.fields]),
        read.filter(bad).withColumn("parse_error", reason).drop("_log"),
    )


def decode_log_json(df: DataFrame) -> DataFrame:
    """JSON-text columns to nested columns; null text gives null."""
    cols = {n: F.from_json(j, t) for n, (j, t) in JSON_COLUMNS.items() if j in df.columns}
    return df.withColumns(cols).drop(*[JSON_COLUMNS[n][0] for n in cols])


def encode_log_json(df: DataFrame) -> DataFrame:
    """Nested columns to JSON text."""
    cols = {j: F.to_json(n, JSON_WRITE) for n, (j, _) in JSON_COLUMNS.items() if n in df.columns}
    return df.withColumns(cols).drop(*[n for n, (j, _) in JSON_COLUMNS.items() if j in cols])

"""Size checks for joins, and where checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
TASK_ROWS = 250_000
CHECKPOINT_CONF = "spark.checkpoint.dir"


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; above the bound the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, from the session."""
    return spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint when the session names a shared folder, else the plan itself."""
    folder = checkpoint_dir(df.sparkSession)
    if not folder:
        return df
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read from there: computed once, and plans do not grow in loops.

    In local mode a scratch folder stands in where the session names none.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoint-{spark.sparkContext.applicationId}"
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Spread a source over all cores, and over more tasks where one would get many rows.

    A file is read by as many tasks as it has row groups, whatever number of splits it is cut
    into, and every narrow stage on it stays there.  So the rows of each split are counted
    (numbers of the footers, no column is read); a source whose splits are many and small is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        sizes = df.groupBy(F.spark_partition_id().alias("_split")).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
        if (sizes.most or 0) <= max(task_rows, 2 * sizes.n // cores if sizes.n <= task_rows * cores else 0):
            return df
        rows = sizes.n
    else:
        rows = df.count()
    return df.repartition(max(cores, -(-rows // task_rows)))

"""Lookups by id read what may have the id."""

import tempfile

import pytest
from pyspark.sql import functions as F

from logwarden.operators import lookups
from logwarden.sources import sinks

CASES = [
    ("logs", "trace_id", lookups.log_by_trace), ("tasks", "task_id", lookups.task_by_id),
    ("approvals", "task_id", lookups.approval_by_task), ("pending_blocks", "block_id", lookups.block_by_id)]


def rows_read(df):
    """Rows that the Parquet reader hands on, before any filter."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if "Scan parquet" in leaves.apply(i).nodeName()]
    assert len(scans) == 1
    return scans[0].metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("table, column, lookup", CASES)
def test_lookups_read_the_rows_that_may_match(spark, table, column, lookup):
    root = tempfile.mkdtemp(prefix="lw-lookup-")
    n = 60_000
    for batch in range(3):
        rows = spark.range(batch * n, (batch + 1) * n, 1, 4).select(
            F.sha2(F.col("id").cast("string"), 256).alias(column), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 7).alias(sinks.TABLES[table]),
            F.repeat(F.sha2(F.hash("id").cast("string"), 256), 3).alias("body"))
        sinks.append_table(rows, root, table, batch)
    stored = sinks.read_table(spark, root, table)
    some = spark.range(1).select(F.sha2(F.lit("70000"), 256)).first()[0]
    found = lookup(stored, some)
    assert [r[column] for r in found.collect()] == [some]
    # Pages of about a megabyte or 20,000 rows: one or two of the batch that has it, and none of the others.
    assert 1 <= rows_read(found) <= 40_000 and stored.count() == 3 * n
    absent = lookup(stored, "f" * 63 + "g")
    assert absent.count() == 0
    inside = lookup(stored, spark.range(1).select(F.sha2(F.lit("never stored"), 256)).first()[0])
    assert inside.count() == 0 and rows_read(inside) == 0  # inside the range of every file: only the filters can tell

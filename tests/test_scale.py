"""Work is spread by rows, made once and not shuffled twice."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

import parity.streams as streams
from logwarden.operators import integrity
from logwarden.plans.sizing import spread_small
from logwarden.sources import sinks
from logwarden.streaming.decisions import Machine
from logwarden.streaming.keyed import _Dedup
from logwarden.streaming.tables import StreamFlow
from logwarden.config import load_rules
from parity.inputs import norm_logs
from parity.rules import CONF


def test_a_large_row_group_is_spread_by_its_rows(spark, tmp_path):
    spark.range(40_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    spread = spread_small(spark.read.parquet(str(tmp_path / "t")), task_rows=500)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 1_000


def test_a_shuffled_stream_has_files_by_rows_in_each_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "scratch", lambda spark: str(tmp_path))
    monkeypatch.setattr(streams, "FILE_ROWS", 10, raising=False)
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, start + timedelta(hours=i // 50)) for i in range(200)], "id long, timestamp timestamp")
    stream = streams.shuffled_stream(spark, rows, "id", {"timestamp": F.lit(streams.LATER)})
    seen = []
    q = (stream.writeStream.foreachBatch(lambda df, i: seen.append(df.count()))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(seen) == 5 and seen[-1] == 1 and sum(seen) == 201
    assert len(list((tmp_path / "files").glob("*.parquet"))) == 25


def test_tasks_that_are_written_often_are_made_once(spark, sf, monkeypatch):
    calls, make = [], streams.task_df
    monkeypatch.setattr(streams, "task_df", lambda *a: calls.append(1) or make(*a))
    streams.query.__globals__["QUERIES"]["audit_sinks"](spark, sf).collect()
    assert len(calls) == 1


def test_the_text_of_a_chain_is_made_behind_the_shuffle(spark, sf, capsys):
    logs = norm_logs(spark, sf).withColumn("day", F.lit("d"))
    integrity.build_hash_chain(logs, ["day"], ["timestamp", "trace_id"], b"0" * 32, lanes=2).explain("formatted")
    tree = capsys.readouterr().out.split("\n\n")[0]
    fold = tree[:tree.index("Exchange")]
    assert "MapInArrow" in fold and "Project" in fold


def test_chained_rows_are_not_shuffled_again(spark, sf, tmp_path, monkeypatch):
    seen, append = {}, sinks.append_table

    def spy(df, root, table, batch_id, date_from=None, rebalance=True):
        seen[table] = rebalance
        append(df, root, table, batch_id, date_from, rebalance)

    monkeypatch.setattr(sinks, "append_table", spy)
    rules = load_rules({**CONF, "authorization": {}, "response": {}, "agent": {}})
    StreamFlow(rules, str(tmp_path))._chained(norm_logs(spark, sf).drop("event_id"), 0, None)
    assert seen["chained"] is False


def test_keys_without_answers_make_no_frames():
    assert list(_Dedup(1, 60).result([])) == []
    assert list(Machine((), True, 60).result([])) == []

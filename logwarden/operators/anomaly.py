"""Frequency anomalies from sliding counts.

A count over [t - w, t] is the running count at t minus the running count just
before t - w.  Both are running counts inside a narrow time slice plus the rows
in the slices before it, so a key with a third of all rows is spread over its
slices, and the work is linear however many rows a window holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text
from ..schemas import PAYLOAD


def metric_key() -> Column:
    return F.concat_ws("|", text("type"), text("boundary"))


def sliding_counts(
    df: DataFrame, key: str, us: str, order: str, widths_us: Mapping[str, int], slice_us: int | None = None,
    carry: Sequence[str] = (), emit: Column | None = None,
) -> DataFrame:
    """Per row the rows of its key in [t - w, t] that arrived up to it, per width.

    ``order`` breaks ties between equal times; with ``carry`` it must tell the rows of a key apart.
    Rows for which ``emit`` is false count but give no output.
    """
    slice_us = slice_us or max(1, min(widths_us.values()))
    names = list(widths_us)
    points = [F.struct(F.lit("").alias("what"), F.col(us).alias("at"), F.lit(1).alias("is_row"))]
    for n in names:
        points.append(F.struct(F.lit(n).alias("what"), (F.col(us) - widths_us[n]).alias("at"), F.lit(0).alias("is_row")))
    wanted = F.array(*points) if emit is None else F.when(emit, F.array(*points)).otherwise(F.array(points[0]))
    rows = df.select(F.col(key).alias("_k"), F.col(us).alias("_us"), F.col(order).alias("_o"), *carry,
                     *([] if emit is None else [emit.alias("_emit")]), F.inline(wanted))
    rows = rows.withColumn("_slice", F.floor(F.col("at") / F.lit(slice_us)).cast("bigint"))

    before = (
        rows.groupBy("_k", "_slice").agg(F.sum("is_row").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(
            Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("_k", "_slice", "_before")
    )
    # A probe sorts before the rows of its own time: those are still inside.
    local = Window.partitionBy("_k", "_slice").orderBy("at", "is_row", "_o", *carry).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("_local", F.sum("is_row").over(local))
    counted = (
        (numbered if emit is None else numbered.filter("_emit"))
        .join(before, ["_k", "_slice"])
        .withColumn("_c", F.col("_local") + F.col("_before"))
    )
    up_to = F.max(F.when(F.col("what") == "", F.col("_c")))
    out = counted.groupBy("_k", "_us", "_o", *carry).agg(
        *[(up_to - F.max(F.when(F.col("what") == n, F.col("_c")))).cast("bigint").alias(n) for n in names]
    )
    return out.withColumnsRenamed({"_k": key, "_us": us, "_o": order})


def sliding_count(df: DataFrame, key: str, us: str, order: str, width_us: int, out: str = "n", **kw) -> DataFrame:
    return sliding_counts(df, key, us, order, {out: width_us}, **kw)


def detect_anomaly(
    df: DataFrame, window_sec: int = 60, baseline_sec: int = 600, threshold_pct: float = 300.0,
    min_baseline: float = 3.0, order: str = "trace_id", carry: Sequence[str] = (), slice_sec: int | None = None,
    emit: Column | None = None,
) -> DataFrame:
    """Anomaly detections over normalised logs of every origin.

    Output: ``order`` and ``carry`` columns plus the detection fields.
    """
    logs = df.select(metric_key().alias("metric_key"), F.unix_micros("timestamp").alias("event_us"), order, *carry,
                     *([] if emit is None else [emit.alias("_wanted")]))
    counts = sliding_counts(
        logs, "metric_key", "event_us", order,
        {"_cw": window_sec * 1_000_000, "_cb": baseline_sec * 1_000_000},
        slice_us=slice_sec * 1_000_000 if slice_sec else None, carry=carry, emit=None if emit is None else F.col("_wanted"),
    )
    return anomaly_rows(counts, window_sec, baseline_sec, threshold_pct, min_baseline)


def anomaly_rows(
    counts: DataFrame, window_sec: int, baseline_sec: int, threshold_pct: float, min_baseline: float,
) -> DataFrame:
    """Detections from rows with the counts ``_cw`` and ``_cb``; shared with the stream form."""
    ratio = baseline_sec / window_sec if baseline_sec > 0 else 1.0
    scored = (
        counts.withColumn("baseline", F.col("_cb") / F.lit(float(ratio)))
        .withColumn("observed", F.col("_cw").cast("double"))
        .filter(F.col("baseline") >= F.lit(float(min_baseline)))
        .withColumn("deviation_pct", F.col("observed") / F.col("baseline") * 100)
        .filter(F.col("deviation_pct") >= F.lit(float(threshold_pct)))
    )
    body = [F.lit("anomaly").alias("kind")]
    for f in PAYLOAD.fields[1:]:
        known = f.name in ("metric_key", "baseline", "observed", "deviation_pct")
        body.append((F.col(f.name) if known else F.lit(None).cast(f.dataType)).alias(f.name))
    return scored.withColumns({
        "rule_pos": F.lit(1_000_000),
        "event_name": F.lit("ANOMALY_DETECTED"),
        "priority": F.when(F.col("deviation_pct") >= 500, "HIGH").otherwise("MEDIUM"),
        "score": F.greatest(F.least(F.col("deviation_pct") / 1000, F.lit(1.0)), F.lit(0.0)),
        "rule_id": F.lit("anomaly-frequency"),
        "payload": F.struct(*body),
    }).drop("_cw", "_cb", "baseline", "observed", "deviation_pct", "metric_key", "event_us")

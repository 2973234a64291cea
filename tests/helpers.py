"""Rows of logs with defaults, and plain-Python references for the ordered operators."""

from __future__ import annotations

from datetime import datetime, timedelta

from logwarden.operators.normalize import normalize
from logwarden.schemas import LOG_SCHEMA

T0 = datetime(2026, 1, 1)


def log(**kw):
    row = {f: None for f in LOG_SCHEMA.fieldNames()}
    row.update(trace_id="t-1", type="SYSTEM", level=3, timestamp=T0, logical_clock=1000, boundary="svc:handler",
               origin="SYSTEM", is_critical=False, message="Test log message", tags=[], resource_ids=[])
    row.update(kw)
    return row


def logs(spark, *rows):
    return spark.createDataFrame([log(**r) for r in rows], LOG_SCHEMA)


def norm(spark, *rows):
    return normalize(logs(spark, *rows), "svc")


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def kept_by_walk(rows, window):
    """rows: (key, time, tie).  The rows a walk in order keeps."""
    last, out = {}, set()
    for key, t, tie in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or t - last[key] > window:
            last[key] = t
            out.add((key, t, tie))
    return out


def counts_by_scan(rows, width):
    """rows: (key, time, tie).  Per row the earlier arrivals within the width."""
    seen, out = {}, {}
    for key, t, tie in sorted(rows, key=lambda r: (r[1], r[2])):
        times = seen.setdefault(key, [])
        times.append(t)
        out[(key, t, tie)] = sum(1 for x in times if x >= t - width)
    return out

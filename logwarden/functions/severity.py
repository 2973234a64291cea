"""Ordinal comparisons and the severity decision table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PRIORITIES, SEVERITIES


def _ordinal(c: Column, names: tuple[str, ...]) -> Column:
    expr = F.lit(0)
    for i, name in enumerate(names):
        if i:
            expr = F.when(c == name, F.lit(i)).otherwise(expr)
    return expr


def severity_rank(c: Column) -> Column:
    """INFO 0 .. CRITICAL 4; unknown counts as 0."""
    return _ordinal(c, SEVERITIES)


def priority_rank(c: Column) -> Column:
    """LOW 0 .. HIGH 2; unknown counts as 0."""
    return _ordinal(c, PRIORITIES)


def severity_gte(actual: Column, threshold: Column) -> Column:
    return severity_rank(actual) >= severity_rank(threshold)


def level_severity(level: Column) -> Column:
    return (
        F.when(level >= 6, "CRITICAL").when(level >= 5, "HIGH").when(level >= 4, "MEDIUM")
        .when(level >= 3, "LOW").otherwise("INFO")
    )


def classify_severity(event: Column, priority: Column, level: Column, is_critical: Column) -> Column:
    return (
        F.when(F.coalesce(is_critical, F.lit(False)), "CRITICAL")
        .when(event == "SECURITY_INTRUSION_DETECTED", F.when(level >= 6, "CRITICAL").otherwise("HIGH"))
        .when(event == "SYSTEM_CRITICAL_FAILURE", F.when(priority == "HIGH", "CRITICAL").otherwise("HIGH"))
        .when(event == "COMPLIANCE_VIOLATION", "HIGH")
        .when(event == "AI_ACTION_REQUIRED", "MEDIUM")
        .otherwise(level_severity(level))
    )

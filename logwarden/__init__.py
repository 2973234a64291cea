"""Logs to detections, responses and tasks, as Spark plans."""

from .config import RuleSet, load_rules

__all__ = ["RuleSet", "load_rules"]

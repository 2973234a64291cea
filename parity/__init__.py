"""Queries over the given tables and the SQL that must give the same rows."""

from pyspark import cloudpickle

import logwarden

# Executors need not have the packages installed: their functions travel by value.
cloudpickle.register_pickle_by_value(logwarden)

from . import intake, outcomes, signals, streams  # noqa: E402,F401
from .registry import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]

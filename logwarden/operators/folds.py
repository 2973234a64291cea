"""Ordered folds over key groups of any size.

A fold reads a partition sorted by (group, order) as a stream of Arrow batches
and carries a small state from row to row, so a group is never held in memory.
``repartition`` by columns is used without a count: adaptive execution may merge
whole partitions but does not split them, which would cut a group in two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]


def grouped(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole groups per partition, in order."""
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def fold_batches(
    df: DataFrame, group: Sequence[str], order: Sequence[str],
    fn: Callable[[Batches], Batches], schema: T.StructType,
) -> DataFrame:
    return grouped(df, group, order).mapInArrow(fn, schema)


def runs(keys: list[tuple]) -> Iterator[tuple[int, int, tuple]]:
    """(start, stop, key) of the stretches of equal keys in a sorted list."""
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i, keys[start]
            start = i

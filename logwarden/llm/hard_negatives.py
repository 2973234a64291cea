"""Hard-negative mining: for each anchor and positive the best negatives whose score lies in the positive's window.

A window is ``low * positive_score <= 100 * score <= high * positive_score``.  The windows of
one anchor overlap, so they are not searched one by one: their distinct upper limits cut
the scores into disjoint slots, from the highest limit down.  Every task keeps the best
``negatives`` of each slot (a rank filter that Spark applies before and after the
shuffle), and one pass from the lowest slot up, in which each slot's best are put before
those of the slots below, holds the best under each upper limit.  What is below a
window's lower limit is cut off at the end; as scores fall along the list, this is exact.

Anchors are scored against all rows in cells of a grid: rows and anchors are dealt to
blocks of bounded size by a hash of the whole row, and every pair of an anchor block and
a row block is one group.  No block depends on a label or an id, so common labels are
no larger tasks.  Two passes: the first, over pairs of equal labels, finds the positives.

Scores are exact inner products of ``floor(scale * x)``.  Rows without an id or a label, or
with a null, empty or not finite vector take no part; rows equal in id, label and vector
count once; rows that share an id but differ are rows of their own, but not partners of one
another.  Vectors of different lengths have no score.  Labels are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import as_lists, integer_lists, products

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
ROW_BLOCK, ANCHOR_BLOCK = 8192, 4096
LEAST_BLOCK = 256
#: Anchors scored at a time inside a cell.
TILE = 256


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """id, label, v (whole components) of the rows that take part, each once, with a hash of label and vector."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            mask, sizes, whole = integer_lists(batch.column("v"), scale)
            kept = batch.filter(pa.array(mask))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), as_lists(whole, sizes)], names=["id", "label", "v"])

    own = rows.select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(embedding).alias("v"))
    given = own.where("id is not null and label is not null and size(v) > 0")
    return given.mapInArrow(run, "id bigint, label bigint, v array<int>").distinct().withColumn("hash", F.xxhash64("label", "v"))


def lists_by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (row numbers, matrix) of a column of integer lists."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(sizes, sizes)
    return {int(n): (np.flatnonzero(sizes == n), flat[of == n].reshape(-1, n)) for n in np.unique(sizes)}


def lowest(scores: np.ndarray):
    return -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min


def best(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """k times the largest of each row that is left: rows, columns, values; the first column of equal values."""
    none, every = lowest(scores), np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        column = scores.argmax(1)
        value = scores[every, column]
        found = np.flatnonzero(value != none)
        if not len(found):
            break
        yield found, column[found], value[found].astype(np.int64)
        scores[every, column] = none


def tiles(anchors: pa.Table, rows: pa.Table, same_label: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor numbers, ids of rows in ascending order, their scores), for rows of the same label or of all others.

    A score that does not count is the lowest value of its type.
    """
    of_rows = lists_by_length(rows["v"])
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    anchor_ids, anchor_labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
    for length, (numbers, own) in lists_by_length(anchors["v"]).items():
        if length not in of_rows:
            continue
        at, other = of_rows[length]
        order = np.argsort(ids[at], kind="stable")
        at, other = at[order], other[order]
        for label in np.unique(anchor_labels[numbers]) if same_label else [None]:
            mine = numbers if label is None else numbers[anchor_labels[numbers] == label]
            vectors = own if label is None else own[anchor_labels[numbers] == label]
            theirs = np.arange(len(at)) if label is None else np.flatnonzero(labels[at] == label)
            if not len(theirs):
                continue
            row_ids = ids[at][theirs]
            for i in range(0, len(mine), TILE):
                part = mine[i:i + TILE]
                scores = products(vectors[i:i + TILE], other[theirs])
                none = lowest(scores)
                if label is None:
                    scores[anchor_labels[part][:, None] == labels[at][theirs][None, :]] = none
                first, last = (np.searchsorted(row_ids, anchor_ids[part], side) for side in ("left", "right"))
                for row in np.flatnonzero(first < last):
                    scores[row, first[row]:last[row]] = none  # its own row
                yield part, row_ids, scores


CELL_RESULT = "anchor_id bigint, hash bigint, slot int, score bigint, id bigint"


def cell_result(anchors: pa.Table, found: list[tuple]) -> pa.Table:
    """found: (anchor numbers, slot, scores, ids) in pieces."""
    def put(i: int) -> np.ndarray:
        return np.concatenate([np.asarray(x[i], np.int64) for x in found]) if found else np.zeros(0, np.int64)

    number = put(0)
    slots = np.concatenate([np.full(len(x[0]), x[1]) for x in found]) if found else number
    return pa.table({
        "anchor_id": anchors["id"].to_numpy()[number], "hash": anchors["hash"].to_numpy()[number],
        "slot": slots.astype(np.int32), "score": put(2), "id": put(3)})


def best_of_label(k: int):
    """Cell -> the k best rows of each anchor's own label (slot 0)."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(anchors):
            for part, ids, scores in tiles(anchors, rows, True):
                found += [(part[a], 0, value, ids[column]) for a, column, value in best(scores, k)]
        return cell_result(anchors, found)

    return run


def best_of_slots(k: int):
    """Cell -> the k best rows of other labels in each slot of each anchor."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(anchors):
            count = anchors["limits"].combine_chunks().value_lengths().to_numpy()
            limits = np.zeros((len(anchors), max(count)), np.int64)  # descending; a slot that is not there has no scores
            for i, each in enumerate(anchors["limits"].to_pylist()):
                limits[i, :len(each)] = each
            floor = anchors["floor"].to_numpy()
            for part, ids, scores in tiles(anchors, rows, False):
                none = lowest(scores)
                scores[(scores < floor[part][:, None]) | (scores > limits[part, 0][:, None])] = none
                for slot in range(limits.shape[1]):
                    live = np.flatnonzero(count[part] > slot)
                    if not len(live):
                        break
                    below = np.where(count[part[live]] > slot + 1, limits[part[live], min(slot + 1, limits.shape[1] - 1)], floor[part[live]] - 1)
                    own = scores[live]
                    own[(own > limits[part[live], slot][:, None]) | (own <= below[:, None])] = none
                    found += [(part[live[a]], slot, value, ids[column]) for a, column, value in best(own, k)]
        return cell_result(anchors, found)

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best by anchor and slot; Spark filters by rank before the shuffle as well."""
    from pyspark.sql import Window

    w = Window.partitionBy("anchor_id", "hash", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def blocks(count: int, size: int) -> int:
    return max(1, -(-count // size))


def mine_hard_negatives(
    rows: DataFrame, anchor: Callable[[Column], Column], *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says of an id whether its row is an anchor; ``low`` and ``high`` are percent.
    """
    own = written(integer_vectors(rows, vec_id, embedding, label, scale))
    size = own.agg(F.count("*").alias("rows"), F.count_if(anchor(F.col("id"))).alias("anchors")).first()
    # A few hundred rows are a block where there are tasks for it, a full block where there are many rows.
    spread = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks(size.rows, min(row_block, LEAST_BLOCK)))
    row_blocks, anchor_blocks = max(blocks(size.rows, row_block), spread), blocks(size.anchors, anchor_block)
    anchors = own.where(anchor(F.col("id"))).toDF(*own.columns)  # columns of its own, as it meets ``own`` again

    def cells(df: DataFrame, mine: str, n: int, other: str, n_other: int) -> DataFrame:
        # Both sides of a cogroup need keys of one type: Spark hashes int and bigint differently.
        return df.withColumn(mine, F.pmod(F.xxhash64("id", "hash"), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def grid(anchors: DataFrame, function) -> DataFrame:
        dealt = cells(own, "q", row_blocks, "p", anchor_blocks).groupBy("p", "q")
        return dealt.cogroup(cells(anchors, "p", anchor_blocks, "q", row_blocks).groupBy("p", "q")).applyInArrow(function, CELL_RESULT)

    partners = written(top(grid(anchors, best_of_label(positives)), positives).groupBy("anchor_id", "hash").agg(
        F.sort_array(F.collect_list(F.struct(F.col("n"), F.col("score"), F.col("id")))).alias("positives")))
    # Windows of negative scores are empty.  Whole scores: limits are rounded inwards.
    usable = F.filter("positives", lambda p: p["score"] >= 0)
    upper = F.array_distinct(F.transform(usable, lambda p: F.floor(p["score"] * high / F.lit(100).cast("decimal(3,0)")).cast("bigint")))
    lower = F.transform(usable, lambda p: F.ceil(p["score"] * low / F.lit(100).cast("decimal(3,0)")).cast("bigint"))
    windows = partners.select("anchor_id", "hash", upper.alias("limits"), F.array_min(lower).alias("floor"), F.col("positives")).where("size(limits) > 0")
    slotted = anchors.join(windows.select(F.col("anchor_id").alias("id"), "hash", "limits", "floor"), ["id", "hash"])
    # At most positives * negatives rows of an anchor are left here.
    found = top(grid(slotted, best_of_slots(negatives)), negatives).groupBy("anchor_id", "hash").agg(
        F.sort_array(F.collect_list(F.struct("slot", "n", "score", "id"))).alias("found"))
    merged = found.join(windows, ["anchor_id", "hash"])
    # From the lowest slot up: the best under a limit are those of its slot, then those under the next limit.
    suffixes = F.reverse(F.aggregate(
        F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1)), F.array().cast("array<array<struct<slot:int,n:int,score:bigint,id:bigint>>>"),
        lambda acc, s: F.concat(acc, F.array(F.slice(F.concat(
            F.filter("found", lambda x: x["slot"] == s), F.coalesce(F.try_element_at(acc, F.lit(-1)), F.array().cast("array<struct<slot:int,n:int,score:bigint,id:bigint>>"))),
            1, negatives)))))
    each = merged.withColumn("suffixes", suffixes).withColumn("positive", F.explode(F.filter("positives", lambda p: p["score"] >= 0)))
    limit = F.floor(F.col("positive.score") * high / F.lit(100).cast("decimal(3,0)")).cast("bigint")
    mine = F.element_at("suffixes", F.array_position("limits", limit).cast("int"))
    inside = F.filter(mine, lambda x: x["score"] * 100 >= F.col("positive.score") * low)
    return each.select("anchor_id", "positive", F.posexplode(inside).alias("at", "negative")).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("negative.id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"))

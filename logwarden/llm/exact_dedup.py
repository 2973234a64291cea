"""Exact deduplication by grace hashing: equal texts meet in one bucket and are compared byte by byte.

Records are dealt to buckets by a 64-bit hash of the text.  The task of a bucket puts
them into an open-addressing table: slots hold a hash and a record number, a probe runs
on to the next slot, and only equal *contents* are one entry, whatever their hashes.  The
contents in a table have a fixed budget of bytes.  A record that is not in a full table is
spilled: it is written to the shared folder and dealt anew, by other bits and to as many
buckets as the spilled bytes need, until nothing is spilled.  Every level places at least
one content of each bucket, so it ends, also with texts larger than the budget.

Copies are merged in the tasks that read them, before they are dealt, and again in the
tasks that read spilled records: a text that a third of all rows share arrives once for
each task.  Budgets count distinct contents only, so a large group of copies never fills
a table.  Texts are written only when spilled; a group leaves its bucket as one row with
the SHA-256 of its text, by which documents find their group.  That join has one row per
group on one side, so Spark may split a large group on the other.

Null texts count as empty (after ``normalise``, which says what equal means; by default
nothing is changed).  The row with the largest id stays, a null id counts below all others.
Rows that agree in id and text are copies of one another: one of them stays.  Ids are of
any type that Spark and Python order alike (numbers, strings, dates).
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder

#: Bytes of distinct contents in a table, and bytes that a bucket is planned for.
TABLE_BYTES = 64 << 20
BUCKET_BYTES = 24 << 20
#: Rows, and bytes of contents, in one batch to Spark.
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20


class ContentTable:
    """Open addressing with linear probing; an entry is (content, rows, largest id, rows that have it)."""

    def __init__(self, budget: int):
        self.budget = budget
        self.clear()

    def clear(self) -> None:
        self.bytes, self.mask = 0, 1023
        self.slots = array("q", [-1]) * (self.mask + 1)
        self.hashes: list[int] = []
        self.entries: list[list] = []

    def grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = array("q", [-1]) * (self.mask + 1)
        for number, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = number

    def add(self, h: int, content: bytes, rows: int, top, top_rows: int) -> bool:
        """False, and nothing changed, if the content is new and does not fit."""
        at = h & self.mask
        while (number := self.slots[at]) >= 0:
            if self.hashes[number] == h and self.entries[number][0] == content:  # the whole content decides
                entry = self.entries[number]
                entry[1] += rows
                if top is not None and (entry[2] is None or top > entry[2]):
                    entry[2], entry[3] = top, top_rows
                elif top == entry[2]:
                    entry[3] += top_rows
                return True
            at = (at + 1) & self.mask
        if self.entries and self.bytes + len(content) > self.budget:
            return False
        self.slots[at] = len(self.entries)
        self.hashes.append(h)
        self.entries.append([content, rows, top, top_rows])
        self.bytes += len(content)
        if 2 * len(self.entries) > self.mask:
            self.grow()
        return True


def record_type(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("h", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("rows", T.LongType()),
        T.StructField("top", id_type), T.StructField("top_rows", T.LongType())])


def group_type(id_type: T.DataType) -> T.StructType:
    """A group has its digest and no content, a spilled record its content and no digest."""
    return T.StructType([*record_type(id_type), T.StructField("digest", T.BinaryType())])


def batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches bounded in rows and in bytes of contents."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[1] or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)), strict=True)))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)), strict=True)))


def typed(found: Iterator[pa.RecordBatch], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Columns of nulls, or of narrower types, get the types that Spark expects."""
    for batch in found:
        yield pa.RecordBatch.from_arrays([batch.column(c).cast(k) for c, k in kinds.items()], names=list(kinds))


def arrow_kinds(schema: T.StructType) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema}


def merge_copies(budget: int, kinds: dict[str, pa.DataType]):
    """(content, rows, top, top_rows) -> the same with copies in this task merged; a full table is emptied and used again."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            table = ContentTable(budget)

            def flush():
                for h, entry in zip(table.hashes, table.entries, strict=True):
                    yield (h - (1 << 63), *entry)
                table.clear()

            for batch in it:
                columns = [batch.column(c).to_pylist() for c in ("content", "rows", "top", "top_rows")]
                for content, n, top, top_n in zip(*columns, strict=True):
                    h = xxhash.xxh64_intdigest(content)
                    if not table.add(h, content, n, top, top_n):
                        yield from flush()
                        table.add(h, content, n, top, top_n)
            yield from flush()

        yield from typed(batches(rows(), list(kinds)), kinds)

    return run


def settle(budget: int, kinds: dict[str, pa.DataType]):
    """Records of whole buckets -> groups, and the records that did not fit."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            table = ContentTable(budget)
            for batch in it:
                columns = [batch.column(c).to_pylist() for c in ("h", "content", "rows", "top", "top_rows")]
                for h, content, n, top, top_n in zip(*columns, strict=True):
                    if not table.add(h + (1 << 63), content, n, top, top_n):
                        yield h, content, n, top, top_n, None
            for h, (content, n, top, top_n) in zip(table.hashes, table.entries, strict=True):
                yield h - (1 << 63), None, n, top, top_n, sha256(content).digest()

        yield from typed(batches(rows(), list(kinds)), kinds)

    return run


def level_table(spark: SparkSession, path: str, groups: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*groups, T.StructField("spilled", T.BooleanType())])).parquet(path)


def content(text: Column, normalise: Callable[[Column], Column] | None) -> Column:
    """The bytes that are compared."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.coalesce(normalise(text), F.lit("")).cast("binary") if normalise else text.cast("binary")


def text_groups(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None,
    table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """A row per distinct text: digest (SHA-256), keep_id, group_size, top_rows (rows that have keep_id)."""
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    records, groups = record_type(id_type), group_type(id_type)
    root = f"{shared_folder(spark).rstrip('/')}/grace-{uuid.uuid4().hex}"
    own = docs.select(content(F.col(text), normalise).alias("content"), F.col(doc_id).alias("top"))
    one = F.lit(1).cast("bigint")
    pending = own.select("content", one.alias("rows"), "top", one.alias("top_rows"))
    size = own.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done: list[str] = []
    while True:
        level = len(done)
        merged = pending.mapInArrow(merge_copies(table_bytes, arrow_kinds(records)), records)
        # Each level deals by another hash of the hash, or a bucket would stay whole.
        dealt = merged.repartition(max(least, -(-size // bucket_bytes)), F.xxhash64("h", F.lit(level)))
        out = dealt.mapInArrow(settle(table_bytes, arrow_kinds(groups)), groups)
        done.append(f"{root}/{level}")
        out.withColumn("spilled", F.col("digest").isNull()).write.partitionBy("spilled").parquet(done[-1])
        spilled = level_table(spark, done[-1], groups).where("spilled")
        size = spilled.agg(F.sum(F.octet_length("content"))).first()[0]
        if size is None:
            break
        pending = spilled.select("content", "rows", "top", "top_rows")
    found = reduce(DataFrame.unionByName, [level_table(spark, path, groups).where("not spilled") for path in done])
    return found.select("digest", F.col("top").alias("keep_id"), F.col("rows").alias("group_size"), "top_rows")


def digest(text: Column, normalise: Callable[[Column], Column] | None = None) -> Column:
    return F.unhex(F.sha2(content(text, normalise), 256))


def duplicate_report(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, **options,
) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = text_groups(docs, doc_id=doc_id, text=text, normalise=normalise, **options)
    ids = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text), normalise).alias("digest"))
    # Single texts need no partner: only groups are joined.
    joined = ids.join(groups.where("group_size > 1"), "digest", "left")
    single = F.col("group_size").isNull()
    own = joined.where(single | (F.col("top_rows") == 1) | ~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest")
    # Rows that agree in id and text are told apart by a number only, so they are made from their count, in pieces.
    tied = groups.where("top_rows > 1").withColumn("at", F.explode(F.sequence(F.lit(1), "top_rows", F.lit(4096)))).withColumn(
        "n", F.explode(F.sequence("at", F.least("top_rows", F.col("at") + 4095))))
    tied = tied.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (F.col("n") == 1).alias("kept"), "digest")
    return own.unionByName(tied).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def drop_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, **options,
) -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``."""
    groups = text_groups(docs, doc_id=doc_id, text=text, normalise=normalise, **options).select(
        F.col("digest").alias("__llm_digest"), F.col("keep_id").alias("__llm_id"), F.col("top_rows").alias("__llm_rows"))
    own = digest(F.col(text), normalise)
    kept = docs.join(groups, (own == F.col("__llm_digest")) & F.col(doc_id).eqNullSafe(F.col("__llm_id")))
    once = kept.where("__llm_rows > 1").dropDuplicates(["__llm_digest"])
    return kept.where("__llm_rows = 1").unionByName(once).select(*docs.columns)

"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

A byte goes when a string of ``length`` bytes that covers it also starts earlier: in a
document of smaller id, or earlier in the same document.  Overlaps count; strings are
judged on the input.

Suffixes are named by buckets.  The bucket of 2q bytes at p is made of the
buckets of q bytes at p and at p + q, so names for 2, 4, ... 128 bytes come from one
another by refinement at later offsets (names are 64-bit hashes of bucket pairs, so
equal strings have equal names in all documents and nothing needs to be ranked).

Not all suffixes are dealt: every window of ``length`` bytes is represented by its anchor,
the leftmost smallest ``Q``-byte bucket in it.  Equal windows have equal anchors at equal
offsets.  Anchors are bucketed by their Q bytes and refined once by their context, all
bytes that their windows can reach on either side:

* same bucket, same context, not the first: all windows of that anchor start earlier;
* first of its context, but the bucket has other contexts: its windows are named by all
  their bytes, and those that are not the first of their name start earlier;
* alone in its bucket: nothing repeats.

Each task first settles what its own rows show about each other, so common strings do not
gather in one place.

Null texts are empty.  Null ids are the smallest.  Different texts of one id count as separate
documents in order of a hash of the text.  Rows of equal id and text are judged
as one document (all get its result).  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .ngram_join import MIX, mixed

Q = 32
LENGTH = 100
NO_ID = -(1 << 63)
CHUNK = 100_000
FEW = 64


def refine(buckets: np.ndarray, offset: int) -> np.ndarray:
    """Buckets of p refined by the buckets of p + offset."""
    with np.errstate(over="ignore"):
        return mixed(buckets[:len(buckets) - offset] * MIX + buckets[offset:])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, context, place) of every anchor; place packs first window, offset of the anchor, windows - 1."""
    n, side = len(data), length - Q
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    with np.errstate(over="ignore"):
        b = mixed((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * MIX)
    for k in (1, 2, 4, 8, 16):
        b = refine(b, k)
    low, at = b, np.arange(len(b))
    k = 1
    while k <= side + 1:  # smallest of side + 1 buckets, the leftmost of equals
        step = k if 2 * k <= side + 1 else side + 1 - k
        if step:
            left = low[:-step] <= low[step:]
            at = np.where(left, at[:-step], at[step:])
            low = np.where(left, low[:-step], low[step:])
        k *= 2
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    a = at[first]
    whole = refine(refine(b, 32), 64) if n >= 128 else None
    reach = 2 * side + Q
    inner = (a >= side) & (a + Q + side <= n)
    context = np.zeros(len(a), np.uint64)
    if inner.any():
        p = a[inner] - side
        name = whole[p]
        for k in (*range(128, reach - 128, 128), reach - 128):  # names of 128 bytes over the whole reach
            with np.errstate(over="ignore"):
                name = mixed(name * MIX + whole[p + k])
        context[inner] = name
    for i in np.flatnonzero(~inner):
        s, e = max(0, a[i] - side), min(n, a[i] + Q + side)
        context[i] = xxhash.xxh64_intdigest(data[s:e], seed=int(a[i] - s) * 256 + int(e - a[i]))
    return b[a].view(np.int64), context.view(np.int64), (first << 16) | ((a - first) << 8) | (last - first)


def runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row of the sorted columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The columns sorted from the first on, each row once: a document that is given twice is no repeat of itself."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    keep = runs(*columns)
    return columns if keep.all() else [c[keep] for c in columns]


def spread(names: np.ndarray, rows: np.ndarray) -> None:
    """Names of decided rows become one of a kind, so that they gather in no task."""
    with np.errstate(over="ignore"):
        names[rows] = mixed(names[rows].view(np.uint64) * MIX + rows.astype(np.uint64)).view(np.int64)


def settle_anchors(v, ctx, did, tk, place):
    """Columns of some anchors -> the same, each row once, and their state: 0 to be compared with others, 1 decided
    as not the first of its context, 2 decided as open.

    What these rows show about each other needs no shuffle: one row stands for a
    context, and of a bucket with more than ``FEW`` contexts here, two prove that it is open; the
    windows of the others are named directly.  So a bucket takes a bounded number of rows from each
    ``CHUNK`` anchors, however common it is.
    """
    v, ctx, did, tk, place = distinct(v, ctx, did, tk, place)
    state = np.zeros(len(v), np.int8)
    first = runs(v, ctx)
    state[~first] = 1
    at = np.flatnonzero(first)
    starts = np.flatnonzero(runs(v[at]))
    size = np.diff(np.append(starts, len(at)))
    rank = np.arange(len(at)) - np.repeat(starts, size)
    state[at[(np.repeat(size, size) > FEW) & (rank > 1)]] = 2
    spread(v, np.flatnonzero(state))
    return v, ctx, did, tk, place, state


def settle_windows(name, did, tk, start):
    """Columns of some windows -> the same, each row once, and whether an equal window here starts earlier."""
    name, did, tk, start = distinct(name, did, tk, start)
    later = ~runs(name)
    spread(name, np.flatnonzero(later))
    return name, did, tk, start, later


def in_chunks(read, settle, names: tuple[str, ...]):
    """Batches of documents -> batches of ``settle`` over the columns ``read`` gives, ``CHUNK`` rows or more each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0

        def out():
            columns = settle(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))

        for batch in batches:
            for i in range(batch.num_rows):
                part = read(*(batch.column(c)[i].as_py() for c in range(batch.num_columns)))
                parts.append(part)
                size += len(part[0])
                if size >= CHUNK:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    return run


def anchor_rows(length: int):
    def read(did: int, tk: int, text: str):
        v, ctx, place = anchors(text.encode("utf-8", "replace"), length)
        return v, ctx, np.full(len(v), did), np.full(len(v), tk, np.int32), place

    return in_chunks(read, settle_anchors, ("v", "ctx", "did", "tk", "place", "state"))


def window_rows(length: int):
    """Documents with marks -> name and start of every window of their open anchors."""
    def read(did: int, tk: int, text: str, marks: list[int]):
        data = text.encode("utf-8", "replace")
        starts = [p for m in marks if m & 1 for p in range(m >> 17, (m >> 17) + (m >> 1 & 255) + 1)]
        names = np.array([xxhash.xxh64_intdigest(data[p:p + length]) for p in starts], np.uint64).view(np.int64)
        return names, np.full(len(starts), did), np.full(len(starts), tk, np.int32), np.array(starts, np.int64)

    return in_chunks(read, settle_windows, ("name", "did", "tk", "start", "later"))


def removed_spans(data: bytes, marks, starts, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by windows that start earlier elsewhere."""
    ranges = [(m >> 17, (m >> 17) + (m >> 1 & 255) + length) for m in (marks if marks is not None else ()) if not m & 1]
    ranges += [(p, p + length) for p in (starts if starts is not None else ())]
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("did"), F.hash(whole).alias("tk"), whole.alias("text"))


def repeat_marks(own: DataFrame, length: int) -> DataFrame:
    """did, tk, mark: place << 1, plus 1 if the windows of the anchor are still open."""
    rows = own.mapInArrow(anchor_rows(length), "v bigint, ctx bigint, did bigint, tk int, place bigint, state tinyint")
    same = Window.partitionBy("v", "ctx").orderBy("did", "tk", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bucket = Window.partitionBy("v")
    is_first = (F.first("did").over(same) == F.col("did")) & (F.first("tk").over(same) == F.col("tk")) & (F.first("place").over(same) == F.col("place"))
    ranked = rows.withColumn("first", is_first).withColumn("open", F.min("ctx").over(bucket) != F.max("ctx").over(bucket))
    ranked = ranked.withColumn("first", F.when(F.col("state") == 0, F.col("first")).otherwise(F.col("state") == 2))
    return ranked.where("open or state > 0 or not first").select(
        "did", "tk", (F.col("place") * 2 + F.col("first").cast("int")).alias("mark"))


def find_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """did, tk, text and the marks and starts of each document."""
    if not 96 <= length <= 255 + Q:
        raise ValueError("length is from 96 to 287 bytes")
    own = keyed(docs, doc_id, text)
    marks = written(repeat_marks(own, length))
    per_doc = marks.groupBy("did", "tk").agg(F.collect_set("mark").alias("marks"))
    open_docs = per_doc.where(F.exists("marks", lambda m: m.bitwiseAND(1) == 1))
    windows = own.join(open_docs, ["did", "tk"]).mapInArrow(
        window_rows(length), "name bigint, did bigint, tk int, start bigint, later boolean")
    order = Window.partitionBy("name").orderBy("did", "tk", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_first = (F.first("did").over(order) == F.col("did")) & (F.first("tk").over(order) == F.col("tk")) & (F.first("start").over(order) == F.col("start"))
    starts = windows.withColumn("later", F.col("later") | ~is_first).where("later").groupBy("did", "tk").agg(
        F.collect_set("start").alias("starts"))
    return own.join(per_doc, ["did", "tk"], "left").join(starts, ["did", "tk"], "left")


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, spans (byte offsets), kept (the remaining bytes)."""
    def cut(texts: pd.Series, marks: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, m, s in zip(texts, marks, starts, strict=True):
            data = t.encode("utf-8", "replace")
            spans = removed_spans(data, m, s, length)
            edges = [0] + [x for span in spans for x in span] + [len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "spans", "kept"])

    result = F.pandas_udf(cut, "struct<n_bytes:bigint, n_removed:bigint, spans:array<struct<start:bigint, end:bigint>>, kept:binary>")
    found = find_repeats(docs, doc_id=doc_id, text=text, length=length)
    cut_docs = found.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), result("text", "marks", "starts").alias("r"))
    return cut_docs.select("doc_id", "r.n_bytes", "r.n_removed", "r.spans", "r.kept")

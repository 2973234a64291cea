"""Benchmark decontamination with an Aho-Corasick automaton.

Items and documents are normalised alike: A-Z in lower case, words are runs of
letters and digits of ASCII and of all characters beyond it.  The patterns are the
windows of ``window`` consecutive words of every item (a shorter item is one
window).  Words of the patterns are numbered, other words are 0; one automaton over
the number sequences reads the words of each text once.  A match is a range of words,
mapped back to offsets in the original.

Items are taken in blocks of ``block_chars`` characters at most, so an automaton is
bounded however large the benchmark is; each block is one more pass inside the same
stage, without a shuffle, and all blocks together find what one automaton finds.

Null and empty texts have no words and are clean.  An item without words matches
nothing.  Items with equal windows are all reported.  Repeated rows are scanned
each for itself; extra columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BLOCK_CHARS = 1_000_000

#: Bytes to words: A-Z to lower case, what is no word byte to a space.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "struct<n_words:bigint, first:array<int>, last:array<int>, items:array<string>>"
SPANS = "array<struct<start:int, end:int>>"


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


class Matcher:
    """An automaton over word numbers and the numbers of the words it knows."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in split_words(text)]
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                names = found.setdefault(tuple(ids[i:i + k]), [])
                if not names or names[-1] != item:
                    names.append(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, names in found.items():
            self.machine.add_word(pattern, (len(pattern), names))
        self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit word ranges and ids of the items found."""
        ws = split_words(text)
        if not ws or not self.number:
            return len(ws), [], set()
        get = self.number.get
        ranges, ids = [], set()
        for last, (k, items) in self.machine.iter(tuple([get(w, 0) for w in ws])):
            ranges.append((last - k + 1, last))
            ids.update(items)
        return len(ws), merged(ranges), ids


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges [first, last] joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size; only one block is on the driver at a time."""
    block: list[tuple[str, str]] = []
    chars = 0
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        if block and chars + len(r.t) > block_chars:
            yield block
            block, chars = [], 0
        block.append((r.i, r.t))
        chars += len(r.t)
    yield block


def scan_udf(block: list[tuple[str, str]], window: int):
    @F.pandas_udf(HITS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(block, window)
        for texts in batches:
            n_words, first, last, ids = [], [], [], []
            for text in texts:
                n, ranges, found = matcher.scan(text)
                n_words.append(n)
                first.append([a for a, _ in ranges])
                last.append([b for _, b in ranges])
                ids.append(sorted(found))
            yield pd.DataFrame({"n_words": n_words, "first": first, "last": last, "items": ids})

    return run


def find_contamination(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS, out: str = "contamination",
) -> DataFrame:
    """All columns of ``docs`` and ``out``: n_words, first / last (hit word ranges), items (ids as text, sorted)."""
    for i, block in enumerate(item_blocks(items, item, item_text, block_chars)):
        docs = with_hits(docs, block, window, text, out, more=i > 0)
    return docs


def with_hits(docs: DataFrame, block: list[tuple[str, str]], window: int, text: str, out: str, more: bool) -> DataFrame:
    """The hits of one block in ``out``; with ``more`` they are joined to those in it."""
    hits = scan_udf(block, window)(F.col(text))
    if not more:
        return docs.withColumn(out, hits)
    found = F.col(out)
    return docs.withColumn("__llm_more", hits).withColumn(out, F.struct(
        found["n_words"].alias("n_words"), F.concat(found["first"], F.col("__llm_more.first")).alias("first"),
        F.concat(found["last"], F.col("__llm_more.last")).alias("last"),
        F.array_sort(F.array_union(found["items"], F.col("__llm_more.items"))).alias("items"))).drop("__llm_more")


def n_hit(hits: Column) -> Column:
    """Number of words in at least one range, whatever ranges overlap."""
    ranges = F.array_sort(F.arrays_zip(hits["first"], hits["last"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("to"))
    folded = F.aggregate(ranges, start, lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(s["to"] + 1, r["first"]) + 1)).cast("bigint").alias("n"),
        F.greatest(s["to"], r["last"]).alias("to")))
    return folded["n"]


def original_spans(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
    """Word ranges as spans of code points in the original text, end exclusive."""
    out = []
    for text, first, last in zip(texts, firsts, lasts, strict=True):
        spans = []
        if len(first):
            at = [m.span() for m in WORD.finditer(text)]
            spans = [{"start": at[a][0], "end": at[b][1]} for a, b in merged(list(zip(first, last, strict=True)))]
        out.append(spans)
    return pd.Series(out)


def with_spans(df: DataFrame, *, text: str = "text", hits: str = "contamination", out: str = "spans") -> DataFrame:
    return df.withColumn(out, F.pandas_udf(original_spans, SPANS)(F.col(text), F.col(hits)["first"], F.col(hits)["last"]))


def cut(text: str | None, ranges: list[tuple[int, int]]) -> str | None:
    """The text without the words in the ranges and what stands between them."""
    if text is not None and ranges:
        at = [m.span() for m in WORD.finditer(text)]
        for a, b in reversed(merged(ranges)):
            text = text[:at[a][0]] + text[at[b][1]:]
    return text


def cut_udf(block: list[tuple[str, str]], window: int):
    """Texts and the ranges of earlier blocks -> texts without those and without the hits of this block."""
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher = Matcher(block, window)
        for texts, firsts, lasts in batches:
            yield pd.Series([
                cut(t, [*zip(first, last, strict=True), *matcher.scan(t)[1]])
                for t, first, last in zip(texts, firsts, lasts, strict=True)], dtype=object)

    return run


def remove_contamination(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents with benchmark passages cut out of the text; no document goes.

    The last block (as a rule the only one) is searched and cut by the same function, so a task
    has one Python worker for it.
    """
    hits = "__llm_hits"
    blocks = item_blocks(items, item, item_text, block_chars)
    found, last, more = docs, next(blocks), False
    for block in blocks:
        found, last, more = with_hits(found, last, window, text, hits, more), block, True
    none = F.array().cast("array<int>")
    first_words, last_words = (F.col(hits)["first"], F.col(hits)["last"]) if more else (none, none)
    return found.withColumn(text, cut_udf(last, window)(F.col(text), first_words, last_words)).drop(hits)

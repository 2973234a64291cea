"""Quality rules with cross-document line frequency, in Spark functions only.

Within a text: counts of words, symbols, repeated lines and repeated 3-word windows.
Across texts: lines are normalised (A-Z in lower case, white space runs to one
space) and hashed; a line is boilerplate when more than ``max_docs`` distinct
documents of its host have it and those are more than ``max_share`` of the host's
distinct documents or more than ``enough_docs``, so the limit does not grow with a large host.  Copies of one text count as one document, so a text is not
boilerplate because it was copied.  Boilerplate lines go; a document that loses more
than ``max_removed`` of its words is depleted and rejected.

The host is a column (a null is a host of its own).  Null texts have no words.
Repeated rows each get the same verdict.  Lines are counted with partial sums, the
join that marks them can be split by adaptive execution, so a line or host with a
third of all rows needs no single task.  Lines and texts are compared by 64-bit
hashes, windows within one text as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, words

MAX_DOCS = 20
MAX_SHARE = 0.005
ENOUGH_DOCS = 1000
MAX_REMOVED = 0.7
MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = r"[#*$%&|<>]"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__llm_w", words(F.col(text)))
    df = df.withColumn("__llm_lines", F.filter(F.split(whole, "\n"), lambda x: F.regexp_like(x, F.lit(WORD_CHAR))))
    n = F.size("__llm_w")
    windows = F.when(n >= 4, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__llm_w", i), F.get("__llm_w", i + 1), F.get("__llm_w", i + 2))))
    df = df.withColumn("__llm_h", windows)
    # Only texts with a repeated window go on: (hash, position) sorted, neighbours of equal hash.
    repeated = F.size(F.array_distinct("__llm_h")) < F.size("__llm_h")
    df = df.withColumn("__llm_p", F.when(repeated, F.sort_array(F.transform("__llm_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))

    def equal(p, j):
        return F.coalesce(F.get("__llm_p", j - 1)["x"] == p["x"], F.lit(False)) | F.coalesce(F.get("__llm_p", j + 1)["x"] == p["x"], F.lit(False))

    df = df.withColumn("__llm_at", F.sort_array(F.transform(F.filter("__llm_p", equal), lambda p: p["i"])))
    covered = F.aggregate(
        "__llm_at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["to"])).alias("n"), (i + 3).alias("to")))
    return df.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join("__llm_w", "")).cast("bigint"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size("__llm_lines") - F.size(F.array_distinct("__llm_lines"))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered["n"], F.lit(0)).cast("bigint"),
    }).drop("__llm_w", "__llm_lines", "__llm_h", "__llm_p", "__llm_at")


def host_key(host: Column) -> Column:
    """Never null, so that a null host joins with itself."""
    return F.coalesce(F.concat(F.lit("h:"), host.cast("string")), F.lit(""))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), SPACE, " "))


def host_lines(docs: DataFrame, text: str, host: str, keys: list[str]) -> DataFrame:
    """A row for each line with a word: keys, host, text_key, line (hash), n_words."""
    base = docs.select(
        *keys, host_key(F.col(host)).alias("host"),
        text_key(F.col(text)).alias("text_key"),
        F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("raw"))
    lined = base.withColumn("norm", normal_line(F.col("raw"))).where(F.col("norm") != "")
    n_words = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    return lined.select(*keys, "host", "text_key", F.xxhash64("norm").alias("line"), n_words.alias("line_words"))


def frequent_lines(docs: DataFrame, text: str, host: str, max_docs: int, max_share: float, enough_docs: int = ENOUGH_DOCS) -> DataFrame:
    """host, line, n_docs of the lines above both limits; the second is a share of the host up to ``enough_docs``."""
    lines = host_lines(docs, text, host, []).select("host", "line", "text_key").distinct()
    per_line = lines.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    per_host = docs.select(
        host_key(F.col(host)).alias("host"),
        text_key(F.col(text)).alias("text_key")).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    limit = F.least(max_share * F.col("host_docs"), F.lit(float(enough_docs)))
    return per_line.join(per_host, "host").where(F.col("n_docs") > limit).select("host", "line", "n_docs")


def quality_report(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = MIN_WORDS,
    max_repeated: float = MAX_REPEATED, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED,
    enough_docs: int = ENOUGH_DOCS,
) -> DataFrame:
    """A row per document: doc_id, the counts, base_failed, removed_words, kept."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    counts = text_counts(own).select(
        "doc_id", host_key(F.col("host")).alias("host"),
        text_key(F.col("text")).alias("text_key"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    lost = lost_words(own, doc_id="doc_id", text="text", host="host", max_docs=max_docs, max_share=max_share, enough_docs=enough_docs)
    same = (counts["doc_id"].eqNullSafe(lost["doc_id"])) & (counts["host"] == lost["host"]) & (counts["text_key"] == lost["text_key"])
    df = counts.join(lost, same, "left").select(
        counts["doc_id"], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("removed_words", F.lit(0)).cast("bigint").alias("removed_words"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words")))


def lost_words(
    docs: DataFrame, *, doc_id: str, text: str, host: str, max_docs: int, max_share: float, enough_docs: int = ENOUGH_DOCS,
) -> DataFrame:
    """doc_id, host, text_key, removed_words and removed_lines (hashes), for the documents that have boilerplate lines.

    Equal rows are one here: their lines meet in one group and are divided by their number.
    """
    key = F.col(doc_id).alias("doc_id")
    lines = host_lines(docs, text, host, [key])
    frequent = frequent_lines(docs, text, host, max_docs, max_share, enough_docs).select("host", "line")
    lost = lines.join(frequent, ["host", "line"]).groupBy("doc_id", "host", "text_key").agg(
        F.sum("line_words").alias("words"), F.collect_set("line").alias("removed_lines"))
    copies = docs.select(key, host_key(F.col(host)).alias("host"), text_key(F.col(text)).alias("text_key")).groupBy(
        "doc_id", "host", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    same = lost["doc_id"].eqNullSafe(copies["doc_id"]) & (lost["host"] == copies["host"]) & (lost["text_key"] == copies["text_key"])
    return lost.join(copies, same, "left").select(
        lost["doc_id"], lost["host"], lost["text_key"], F.expr("words div coalesce(n, 1)").alias("removed_words"), "removed_lines")


def remove_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, enough_docs: int = ENOUGH_DOCS,
) -> DataFrame:
    """The documents without their boilerplate lines; other columns as they are."""
    lost = lost_words(docs, doc_id=doc_id, text=text, host=host, max_docs=max_docs, max_share=max_share, enough_docs=enough_docs).select(
        F.col("doc_id").alias("__llm_id"), F.col("host").alias("__llm_host"), F.col("text_key").alias("__llm_key"), F.col("removed_lines").alias("__llm_removed"))
    same = F.col(doc_id).eqNullSafe(F.col("__llm_id")) & (host_key(F.col(host)) == F.col("__llm_host")) & (text_key(F.col(text)) == F.col("__llm_key"))
    left = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col("__llm_removed"), F.xxhash64(normal_line(x))))
    new = F.when(F.col("__llm_removed").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return docs.join(lost, same, "left").withColumn(text, new).select(*docs.columns)

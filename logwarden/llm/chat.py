"""Chat formatting: every assistant turn becomes an example with all turns before it.

A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>``.  Inside roles and
texts a backslash is doubled, and one is put into every control string (``<|``,
``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so no text can end a turn or open one;
removing one level of backslashes gives the original back.

An example is the conversation up to and with one assistant turn; only the text of
that turn is trainable (``loss_start``, ``loss_end``, code points, end exclusive).
Turns after the last assistant turn have no reply to train: they come as one more
example without a trainable part (``target`` null), so nothing is lost.

Order is by turn, then role and text for equal turns; null roles and texts are
empty; null conversation ids are one conversation; repeated rows are repeated turns.
Only Spark functions are used.  A conversation is one row, as its examples are texts
of the whole conversation; the grouping is the only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template and the control strings that texts may not contain.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"(\\|<(?=\||/?s>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """conv_id and turns: array of (role, text), both escaped, in order."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(
        escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))


def format_examples(turns: DataFrame, *, assistant: str = "assistant", **columns) -> DataFrame:
    """Rows of conv_id, target (number of the trained turn from 0, or null), formatted, loss_start, loss_end."""
    formatted = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END)))
    last = F.size("turns") - 1
    numbered = conversations(turns, **columns).withColumn("lines", formatted).withColumn(
        "targets", F.filter(F.sequence(F.lit(0), last), lambda i: F.get("turns", i)["role"] == assistant))
    open_end = F.coalesce(F.get("targets", F.size("targets") - 1), F.lit(-1)) < last
    ends = F.transform("targets", lambda i: F.struct(i.alias("at"), i.alias("target")))
    tail = F.array(F.struct(last.alias("at"), F.lit(None).cast("int").alias("target")))
    rows = numbered.select("conv_id", "turns", "lines", F.explode(F.when(open_end, F.concat(ends, tail)).otherwise(ends)).alias("x"))
    rows = rows.select(
        "conv_id", F.col("x.target").alias("target"),
        F.array_join(F.slice("lines", F.lit(1), F.col("x.at") + 1), "").alias("formatted"),
        F.length(F.get("turns", F.col("x.target"))["text"]).alias("n"))
    end = F.when(F.col("target").isNotNull(), F.length("formatted") - len(END))
    return rows.select("conv_id", "target", "formatted", (end - F.col("n")).alias("loss_start"), end.alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    lines = F.split(formatted, r"<\|im_end\|>")
    bodies = F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x: F.split(F.substr(x, F.lit(len(START) + 1)), r"<\|im_sep\|>"))
    return F.transform(bodies, lambda b: F.struct(unescape(b[0]).alias("role"), unescape(b[1]).alias("text")))


def loss_text(example: DataFrame) -> Column:
    """The trainable text of an example, unescaped; empty without a target."""
    part = F.substr(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return F.coalesce(unescape(part), F.lit(""))


def conversation_digest(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, read back from them.

    The longest example has all turns; the trainable texts are joined in order.
    """
    one = examples.withColumn("loss", loss_text(examples)).groupBy("conv_id").agg(
        F.max_by("formatted", F.length("formatted")).alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "loss")))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"), F.count("target").alias("n_examples"))
    one = one.select("*", read_turns(F.col("longest")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("trained"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return one.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"), F.col("n_examples").cast("bigint").alias("n_examples"))

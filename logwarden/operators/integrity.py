"""Canonical text, hash chains, verification, content hashes.

A chain is inherently sequential, so the unit of parallelism is the chain.  A
chain key that holds too many rows for one task is split into lanes: rows go to
lane ``md5(id) mod lanes`` and every lane is a chain of its own.  Altered,
swapped or deleted rows break their lane; a lane cut off at the end shows in
the signed table of chain heads.

Every row carries its number in its lane (``chain_seq``).  A batch that starts from
the heads of earlier ones counts on from them, so rows are verified in the order
they were chained in, which need not be that of their times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crypto import content_id, hmac_sha256, lane_of, pads, sha256
from ..functions.text import json_text, rfc3339_nano, text
from ..plans.sizing import broadcast_if_small
from .folds import grouped

CHAIN_ROWS = 1_000_000
SEQ = "chain_seq"


# --- canonical text -------------------------------------------------------

# In the canonical text of a row that has no previous hash yet.  What follows it
# holds no free keys, so its last occurrence is the field itself.
OPEN_LINK = '"PreviousHash":""'


def canonical(previous: Column) -> Column:
    """The row as JSON, sorted by name at every level; own hash and signature blank."""
    ai, log = F.col("ai_context"), F.col("agent_back_log")
    ai_json = F.when(ai.isNotNull(), F.struct(
        text(ai["agent_id"]).alias("AgentID"), F.coalesce(ai["confidence"], F.lit(0.0)).alias("Confidence"),
        F.coalesce(ai["loop_depth"], F.lit(0)).alias("LoopDepth"), text(ai["model"]).alias("Model"),
        text(ai["reasoning_trace"]).alias("ReasoningTrace"), text(ai["task_id"]).alias("TaskID"),
    ))
    back = F.transform(log, lambda e: F.struct(
        text(e["action"]).alias("Action"), text(e["agent_id"]).alias("AgentID"), text(e["result"]).alias("Result"),
        text(e["status"]).alias("Status"), rfc3339_nano(e["timestamp"]).alias("Timestamp"),
    ))
    tags = F.transform("tags", lambda t: F.struct(text(t["category"]).alias("Category"), text(t["key"]).alias("Key")))
    details = F.map_from_entries(F.sort_array(F.map_entries("details")))
    js = F.to_json(F.struct(
        ai_json.alias("AIContext"), text("actor_id").alias("ActorID"), back.alias("AgentBackLog"),
        text("boundary").alias("Boundary"), details.alias("Details"), F.lit("").alias("Hash"),
        text("input").alias("Input"), F.col("is_critical").alias("IsCritical"), F.col("level").alias("Level"),
        F.col("logical_clock").alias("LogicalClock"), text("message").alias("Message"),
        text("origin").alias("Origin"), text("parent_span_id").alias("ParentSpanID"),
        previous.alias("PreviousHash"), F.col("resource_ids").alias("ResourceIDs"),
        text("service_id").alias("ServiceID"), F.lit("").alias("Signature"), text("span_id").alias("SpanID"),
        tags.alias("Tags"), rfc3339_nano(F.col("timestamp")).alias("Timestamp"), text("trace_id").alias("TraceID"),
        F.col("trigger_agent").alias("TriggerAgent"), text("type").alias("Type"),
    ), {"ignoreNullFields": "false"})
    # Whole numbers carry no fraction in the canonical form.
    whole = F.regexp_replace(js, r'(?<!\\)"Confidence":(-?\d+)\.0(?=[,}])', '"Confidence":$1')
    return json_text(F.when(ai.isNotNull(), whole).otherwise(js))


def canonical_json(df: DataFrame, column: str = "canonical") -> DataFrame:
    """Serialise every row deterministically."""
    return df.withColumn(column, canonical(text("previous_hash")))


# --- lanes ----------------------------------------------------------------

def with_chain_lane(
    df: DataFrame, chain_cols: Sequence[str], id_col: str = "trace_id", target_rows: int = CHAIN_ROWS,
) -> DataFrame:
    """Add ``chain_lane``: 0 for ordinary chains, 0..n-1 where a chain is too long.

    The rows per chain are counted first (partial counts, one narrow pass).
    Only chains above ``target_rows`` are kept, at most rows / target_rows of them.
    """
    counts = df.groupBy(*chain_cols).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > target_rows).select(
        *[F.col(c).alias(f"_h_{c}") for c in chain_cols],
        F.ceil(F.col("_n") / target_rows).cast("bigint").alias("_lanes"),
    )
    cond = [df[c].eqNullSafe(hot[f"_h_{c}"]) for c in chain_cols]
    joined = df.join(broadcast_if_small(hot), cond, "left")
    lane = F.when(F.col("_lanes").isNull(), F.lit(0)).otherwise(lane_of(F.col(id_col), F.col("_lanes")))
    return joined.withColumn("chain_lane", lane.cast("int")).drop("_lanes", *[f"_h_{c}" for c in chain_cols])


# --- building -------------------------------------------------------------

def _chain_step(group: int, key: bytes | None):
    """Fold over (group.., start, number, is_row, carried.., text): previous hash, hash and number.

    A row with ``is_row`` false opens its group with the head of an earlier run and
    the number of rows up to it.
    """
    def hasher(key):
        if key is None:
            return lambda msg: hashlib.sha256(msg).hexdigest()
        inner, outer = (hashlib.sha256(p) for p in pads(key))

        def run(msg):
            i, o = inner.copy(), outer.copy()
            i.update(msg)
            o.update(i.digest())
            return o.hexdigest()
        return run

    def step(batches):
        digest = hasher(key)
        last_group, previous, number = None, "", 0
        for b in batches:
            groups = zip(*[b.column(i).to_pylist() for i in range(group)])
            starts, counts, is_row = (b.column(group + i).to_pylist() for i in range(3))
            texts = b.column(b.num_columns - 1).to_pylist()
            prevs, hashes, numbers = [], [], []
            for g, start, count, real, body in zip(groups, starts, counts, is_row, texts):
                if g != last_group:
                    last_group, previous, number = g, "", 0
                if not real:
                    previous, number = start, count
                    continue
                number += 1
                numbers.append(number)
                prevs.append(previous)
                head, _, tail = body.rpartition(OPEN_LINK)
                previous = digest(f'{head}"PreviousHash":"{previous}"{tail}{previous}'.encode())
                hashes.append(previous)
            rows = b.filter(pa.array(is_row, pa.bool_()))
            keep = range(group + 3, b.num_columns - 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(i) for i in keep] + [pa.array(prevs, pa.string()), pa.array(hashes, pa.string()), pa.array(numbers, pa.int64())],
                names=[b.schema.names[i] for i in keep] + ["previous_hash", "hash", SEQ],
            )
    return step


def _build(
    df: DataFrame, chain_cols, order_cols, key: bytes | None, target_rows: int, id_col: str, lanes: int | None,
    heads: DataFrame | None,
) -> DataFrame:
    if "chain_lane" in df.columns:
        laned = df
    elif lanes is not None:
        laned = df.withColumn("chain_lane", lane_of(F.col(id_col), F.lit(lanes)).cast("int"))
    else:
        laned = with_chain_lane(df, chain_cols, id_col, target_rows)
    carried = [c for c in laned.columns if c not in ("previous_hash", "hash", SEQ)]
    group = [*[f"_g{i}" for i in range(len(chain_cols))], "_lane"]
    named = [*[F.col(c).alias(g) for c, g in zip(chain_cols, group)], F.col("chain_lane").alias("_lane")]
    ready = laned.select(
        *named, F.lit("").alias("_start"), F.lit(0).cast("bigint").alias("_number"), F.lit(True).alias("_is_row"), *carried)
    if heads is not None:
        ready = ready.unionByName(heads.select(
            *named, F.col("head_hash").alias("_start"), F.col("n_rows").cast("bigint").alias("_number"), F.lit(False).alias("_is_row"),
            *[F.lit(None).cast(laned.schema[c].dataType).alias(c) for c in carried]))
    schema = T.StructType([
        *[T.StructField(c, laned.schema[c].dataType) for c in carried],
        T.StructField("previous_hash", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField(SEQ, T.LongType()),
    ])
    # The text repeats the row: it is made behind the shuffle.
    sorted_rows = grouped(ready, group, ["_is_row", *order_cols]).withColumn("_text", F.when(F.col("_is_row"), canonical(F.lit(""))).otherwise(""))
    return sorted_rows.mapInArrow(_chain_step(len(group), key), schema)


def build_hash_chain(
    df: DataFrame, chain_cols: Sequence[str], order_cols: Sequence[str], key: bytes,
    target_rows: int = CHAIN_ROWS, id_col: str = "trace_id", lanes: int | None = None, heads: DataFrame | None = None,
) -> DataFrame:
    """H_n = HMAC(key, canonical(row n with H_{n-1}) + H_{n-1}); the first H is blank.

    ``heads`` (chain columns, chain_lane, n_rows, head_hash) continues earlier chains, and
    ``lanes`` fixes the lanes of every chain instead of counting rows.  Constant ``chain_cols`` and one lane give the single
    global chain.
    """
    if len(key) < 32:
        raise RuntimeError("HMAC key must be at least 32 bytes")
    return _build(df, chain_cols, order_cols, key, target_rows, id_col, lanes, heads)


def build_sha_chain(
    df: DataFrame, chain_cols: Sequence[str], order_cols: Sequence[str],
    target_rows: int = CHAIN_ROWS, id_col: str = "trace_id", lanes: int | None = None, heads: DataFrame | None = None,
) -> DataFrame:
    """The keyless variant: plain SHA-256."""
    return _build(df, chain_cols, order_cols, None, target_rows, id_col, lanes, heads)


def _signed(chain_cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *chain_cols, F.col("chain_lane"), F.col("n_rows"), F.col("head_hash"))


def chain_heads(df: DataFrame, chain_cols: Sequence[str], order_cols: Sequence[str], key: bytes) -> DataFrame:
    """Signed last hash of every chain lane, and how many rows lead up to it.

    Rows with numbers (``chain_seq``) count from the start of the chain, whatever part
    of it is given; others are counted, and ``order_cols`` says which is the last.
    """
    numbered = SEQ in df.columns
    heads = df.groupBy(*chain_cols, "chain_lane").agg(
        (F.max(SEQ) if numbered else F.count(F.lit(1))).alias("n_rows"),
        F.max_by("hash", F.col(SEQ) if numbered else F.struct(*order_cols)).alias("head_hash"),
    )
    return heads.withColumn("head_signature", hmac_sha256(_signed(chain_cols), key))


def last_heads(heads: DataFrame, chain_cols: Sequence[str]) -> DataFrame:
    """Of the heads of several batches the last of every chain lane."""
    rest = [c for c in ("head_signature",) if c in heads.columns]
    return heads.groupBy(*chain_cols, "chain_lane").agg(
        F.max("n_rows").alias("n_rows"), *[F.max_by(c, "n_rows").alias(c) for c in ("head_hash", *rest)])


# --- verifying ------------------------------------------------------------

def verify_chain(
    df: DataFrame, chain_cols: Sequence[str], order_cols: Sequence[str], keys: Sequence[bytes] | None,
) -> DataFrame:
    """Per row: ``link_ok``, ``hash_ok``, ``key_index`` (which key fits, null if none).

    Every row is checked on its own against the hash of the row before it, so the
    lanes of one chain are verified in parallel.  ``keys=None`` is the keyless variant.

    Chains that several batches made are verified in the order of ``["chain_seq"]``; a number
    that is not the next one counts as a broken link.
    """
    w = Window.partitionBy(*chain_cols, "chain_lane").orderBy(*order_cols)
    next_one = F.lit(True)
    if list(order_cols) == [SEQ]:
        df = df.withColumn("_next", F.lag(SEQ, 1, 0).over(w) + 1)
        next_one = F.coalesce(F.col("_next") == F.col(SEQ), F.lit(False))
    seen = df.withColumn("_expected", F.lag("hash", 1, "").over(w)).withColumn(
        "_body", F.concat(canonical(text("previous_hash")), F.col("_expected")))
    key_index = F.lit(None).cast("int")
    for i in reversed(range(len(keys) if keys is not None else 1)):
        digest = sha256(F.col("_body")) if keys is None else hmac_sha256(F.col("_body"), keys[i])
        key_index = F.when(digest == F.col("hash"), F.lit(i)).otherwise(key_index)
    key_index = F.when(text("hash") != "", key_index)
    return seen.withColumns({
        "link_ok": (text("previous_hash") == F.col("_expected")) & next_one,
        "key_index": key_index,
    }).withColumn("hash_ok", F.col("key_index").isNotNull()).drop("_expected", "_body", "_next")


def chain_report(verified: DataFrame, chain_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Per chain lane: rows, links broken, rows altered, first broken row."""
    bad = ~F.col("link_ok") | ~F.col("hash_ok")
    return verified.groupBy(*chain_cols, "chain_lane").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("link_ok")).alias("links_broken"),
        F.count_if(~F.col("hash_ok")).alias("rows_altered"),
        F.min(F.when(bad, F.struct(*order_cols))).alias("first_broken"),
    )


def verify_heads(df: DataFrame, heads: DataFrame, chain_cols: Sequence[str], keys: Sequence[bytes]) -> DataFrame:
    """Per chain lane the numbered rows that are there against the signed head.

    n_rows and n_missing (rows that the head counts and that are gone, at the end or
    anywhere), ``end_ok`` (the last row is the one that was signed) and ``head_ok`` (one
    of the keys signed the head).  A chain without a head, or a head without rows, shows as well.
    """
    there = df.groupBy(*chain_cols, "chain_lane").agg(
        F.count(F.lit(1)).alias("_n"), F.max(SEQ).alias("_last"), F.max_by("hash", SEQ).alias("_hash"))
    names = [*chain_cols, "chain_lane"]
    told = last_heads(heads, chain_cols).select(*[F.col(c).alias(f"_h_{c}") for c in names], "n_rows", "head_hash", "head_signature")
    both = there.join(told, [there[c].eqNullSafe(told[f"_h_{c}"]) for c in names], "full")
    both = both.select(*[F.coalesce(c, f"_h_{c}").alias(c) for c in names], "_n", "_last", "_hash", "n_rows", "head_hash", "head_signature")
    ok = F.lit(False)
    for key in keys:
        ok = ok | (hmac_sha256(_signed(chain_cols), key) == F.col("head_signature"))
    present = F.coalesce("_n", F.lit(0))
    return both.select(
        *names, present.alias("n_rows"), F.greatest(F.coalesce("n_rows", F.lit(0)) - present, F.lit(0)).alias("n_missing"),
        F.coalesce((F.col("_last") == F.col("n_rows")) & (F.col("_hash") == F.col("head_hash")), F.lit(False)).alias("end_ok"),
        F.coalesce(ok, F.lit(False)).alias("head_ok"))


# --- single-row hashes ----------------------------------------------------

def task_content(df: DataFrame) -> Column:
    """The ten fields of a task an approval is bound to, as JSON."""
    p = F.col("exec_params")
    return json_text(F.to_json(F.struct(
        text("action_type").alias("action_type"),
        text("description").alias("description"),
        text("event_name").alias("event_name"),
        F.struct(
            text(p["target_endpoint"]).alias("TargetEndpoint"),
            text(p["script_identifier"]).alias("ScriptIdentifier"),
            text(p["notification_channel"]).alias("NotificationChannel"),
            text(p["prompt_template"]).alias("PromptTemplate"),
        ).alias("exec_params"),
        text("execution_level").alias("execution_level"),
        text("rule_id").alias("rule_id"),
        text("severity").alias("severity"),
        text("source_message").alias("source_message"),
        text("source_trace_id").alias("source_trace_id"),
        text("task_id").alias("task_id"),
    )))


def task_content_hash(df: DataFrame, column: str = "content_hash") -> DataFrame:
    return df.withColumn(column, sha256(task_content(df)))


def sign_payload(df: DataFrame, column: str, secret: bytes, out: str = "signature") -> DataFrame:
    return df.withColumn(out, hmac_sha256(F.col(column), secret))


def agent_input_hash(df: DataFrame, column: str = "input_hash") -> DataFrame:
    js = json_text(F.to_json(F.struct(text("message").alias("message"), text("trace_id").alias("traceId"))))
    return df.withColumn(column, F.substring(sha256(js), 1, 32))


__all__ = [
    "agent_input_hash", "build_hash_chain", "build_sha_chain", "canonical", "canonical_json",
    "chain_heads", "chain_report", "content_id", "last_heads", "sign_payload", "task_content_hash", "verify_chain",
    "verify_heads", "with_chain_lane",
]

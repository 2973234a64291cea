"""Rule tables: defaults, validation, and the literal columns operators use.

Rules are configuration: a handful to a few thousand small records held on the
driver.  They reach the executors as one folded literal inside the expression,
so looking a rule up needs neither a join nor a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.regex import compiles, spark_pattern
from .schemas import (
    CHAIN_STEP,
    EXEC_PARAMS,
    GUARDRAILS,
    PERMISSION,
    RESPONSE_RULE,
    ROUTING_RULE,
    TASK_RULE,
)

MIN_KEY_BYTES = 32
# Above this many entries a lookup table is joined instead of inlined.
INLINE_LIMIT = 10_000


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_literal(value: Any, dtype: T.DataType) -> str:
    """SQL for a nested Python value; missing struct fields are null."""
    if value is None:
        return f"CAST(NULL AS {dtype.simpleString()})"
    if isinstance(dtype, T.StructType):
        return "named_struct(" + ", ".join(
            f"{sql_text(f.name)}, {sql_literal(value.get(f.name), f.dataType)}" for f in dtype.fields) + ")"
    if isinstance(dtype, T.ArrayType):
        if not value:
            return f"CAST(array() AS {dtype.simpleString()})"
        return "array(" + ", ".join(sql_literal(v, dtype.elementType) for v in value) + ")"
    if isinstance(dtype, T.MapType):
        if not value:
            return f"CAST(map() AS {dtype.simpleString()})"
        return "map(" + ", ".join(
            f"{sql_literal(k, dtype.keyType)}, {sql_literal(v, dtype.valueType)}" for k, v in value.items()) + ")"
    if isinstance(dtype, T.StringType):
        return sql_text(value)
    if isinstance(dtype, T.BooleanType):
        return str(bool(value)).lower()
    return f"CAST({value!r} AS {dtype.simpleString()})"


def literal(value: Any, dtype: T.DataType) -> Column:
    """A typed literal column; one expression however large the value is."""
    return F.expr(sql_literal(value, dtype))


def _filled(row: dict, dtype: T.StructType, pos: int) -> dict:
    """Blank instead of missing scalars, as the rule records define them."""
    blanks = {T.StringType: "", T.IntegerType: 0, T.BooleanType: False}
    out = {}
    for f in dtype.fields:
        v = row.get(f.name)
        if f.name == "rule_pos":
            v = pos
        elif isinstance(f.dataType, T.StructType):
            v = _filled(v or {}, f.dataType, pos)
        elif isinstance(f.dataType, T.ArrayType):
            v = list(v or [])
        elif v is None:
            v = blanks[type(f.dataType)]
        out[f.name] = v
    return out


@dataclass(frozen=True)
class MaskRule:
    """REGEX (pattern, replacement), PII_TYPE (category) or KEY_MATCH (keys)."""

    type: str
    pattern: str = ""
    replacement: str = ""
    category: str = ""
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class MaskPolicy:
    policy_id: str
    rules: tuple[MaskRule, ...] = ()
    log_types: tuple[str, ...] = ()
    origins: tuple[str, ...] = ()
    min_level: int = 0
    max_level: int = 0
    preserve_extra: tuple[str, ...] = ()


@dataclass(frozen=True)
class DynamicRule:
    rule_id: str
    event_name: str
    priority: str = "MEDIUM"
    score: float = 0.0
    payload_builder: str = "system_critical"
    log_types: tuple[str, ...] = ()
    origins: tuple[str, ...] = ()
    min_level: int = 0
    max_level: int = 0
    message_pattern: str = ""
    require_critical: bool | None = None
    tag_keys: tuple[str, ...] = ()


@dataclass
class RuleSet:
    """Everything configurable, with defaults filled."""

    service_id: str = ""
    hmac_key: bytes = b""
    enable_hash_chain: bool = False
    enable_masking: bool = True
    verify_masking: bool = False
    fail_on_persist_error: bool = False
    preserve_fields: list[str] = field(default_factory=list)
    masking_depth_limit: int = 32
    masking_rules: list[MaskRule] = field(default_factory=list)
    masking_policies: list[MaskPolicy] = field(default_factory=list)
    task_rules: list[dict] = field(default_factory=list)
    dynamic_rules: list[DynamicRule] = field(default_factory=list)
    ensemble: bool = False
    aggregator: str = "max"
    threshold: float = 0.5
    dedup_window_sec: int = 0
    anomaly: bool = False
    anomaly_window_sec: int = 60
    anomaly_baseline_sec: int = 600
    anomaly_threshold_pct: float = 300.0
    anomaly_min_baseline: float = 3.0
    authorization: bool = False
    default_role: str = "viewer"
    roles: dict[str, dict] = field(default_factory=dict)
    client_roles: dict[str, str] = field(default_factory=dict)
    response: bool = False
    default_strategy: str = "NOTIFY_ONLY"
    block_mode: str = "IMMEDIATE"
    response_rules: list[dict] = field(default_factory=list)
    routing_rules: list[dict] = field(default_factory=list)
    agent: bool = False
    agent_provider: str = "mock"
    max_loop_depth: int = 5
    allowed_actions: list[str] = field(default_factory=lambda: ["AI_ANALYZE"])
    min_severity: str = "LOW"
    brand: str = "Logwarden"

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        """A rule table as a DataFrame with a ``rule_pos`` column."""
        schema = {
            "task_rules": TASK_RULE,
            "routing_rules": ROUTING_RULE,
            "response_rules": RESPONSE_RULE,
        }
        if name in schema:
            return spark.createDataFrame(getattr(self, name), schema[name])
        if name == "client_roles":
            return spark.createDataFrame(list(self.client_roles.items()), "client_id string, role string")
        if name == "roles":
            dtype = T.StructType([T.StructField("role", T.StringType()), *PERMISSION.fields])
            return spark.createDataFrame([{"role": k, **v} for k, v in self.roles.items()], dtype)
        raise KeyError(name)


def mask_rule(row: dict) -> MaskRule | None:
    """A configured masking rule; a REGEX rule that does not compile is dropped."""
    rule = MaskRule(
        type=row.get("type", ""),
        pattern=row.get("pattern") or "",
        replacement=row.get("replacement") or "",
        category=row.get("category") or "",
        keys=tuple(row.get("keys") or ()),
    )
    if rule.type == "REGEX" and (not rule.pattern or not compiles(spark_pattern(rule.pattern))):
        return None
    return rule


def mask_rules(rows: list[dict]) -> list[MaskRule]:
    return [r for r in map(mask_rule, rows) if r is not None]


def dynamic_rule(row: dict) -> DynamicRule:
    rule = DynamicRule(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()})
    if rule.message_pattern and not compiles(spark_pattern(rule.message_pattern)):
        raise RuntimeError(f"dynamic rule {rule.rule_id}: pattern does not compile: {rule.message_pattern}")
    return rule


def load_rules(conf: dict[str, Any]) -> RuleSet:
    """Build a RuleSet from a nested configuration dict; RuntimeError when invalid."""
    sec = conf.get("security", {})
    flow = conf.get("flow", {})
    ens = conf.get("ensemble", {})
    ano = conf.get("anomaly", {})
    agent = conf.get("agent", {})
    resp = conf.get("response", {})
    authz = conf.get("authorization", {})

    key = sec.get("hmac_key", b"")
    key = key.encode() if isinstance(key, str) else bytes(key)
    chaining = bool(sec.get("enable_hash_chain", False))
    if chaining and len(key) < MIN_KEY_BYTES:
        raise RuntimeError(f"hmac_key must be at least {MIN_KEY_BYTES} bytes when hash chaining is on")
    if not flow.get("service_id"):
        raise RuntimeError("service_id is required")

    policies = [
        MaskPolicy(
            policy_id=p.get("policy_id", ""),
            rules=tuple(mask_rules(p.get("masking_rules", []))),
            log_types=tuple(p.get("log_types", ())),
            origins=tuple(p.get("origins", ())),
            min_level=p.get("min_level", 0),
            max_level=p.get("max_level", 0),
            preserve_extra=tuple(p.get("preserve_extra", ())),
        )
        for p in conf.get("masking_policies", [])
    ]
    roles = {
        name: {
            "allowed_log_types": list(r.get("allowed_log_types") or []),
            "denied_log_types": list(r.get("denied_log_types") or []),
            "max_log_level": r.get("max_log_level") or 0,
            "can_write": bool(r.get("can_write", False)),
            "can_read": bool(r.get("can_read", False)),
            "can_approve": bool(r.get("can_approve", False)),
            "can_admin": bool(r.get("can_admin", False)),
        }
        for name, r in (authz.get("roles") or {}).items()
    }
    return RuleSet(
        service_id=flow["service_id"],
        hmac_key=key,
        enable_hash_chain=chaining,
        enable_masking=bool(sec.get("enable_masking", True)),
        verify_masking=bool(sec.get("verify_masking", False)),
        fail_on_persist_error=bool(flow.get("fail_on_persist_error", False)),
        preserve_fields=list(sec.get("preserve_fields", [])),
        masking_depth_limit=sec.get("masking_depth_limit") or 32,
        masking_rules=mask_rules(sec.get("masking_rules", [])),
        masking_policies=policies,
        task_rules=task_rule_rows(flow.get("rules", [])),
        dynamic_rules=[dynamic_rule(r) for r in ens.get("dynamic_rules", [])],
        ensemble=bool(ens.get("enabled", False)),
        aggregator=ens.get("aggregator") or "max",
        threshold=ens.get("threshold") or 0.5,
        dedup_window_sec=ens.get("dedup_window_sec") or 0,
        anomaly=bool(ano.get("enabled", False)),
        anomaly_window_sec=ano.get("window_size_sec") or 60,
        anomaly_baseline_sec=ano.get("baseline_window_sec") or 600,
        anomaly_threshold_pct=ano.get("threshold_pct") or 300.0,
        anomaly_min_baseline=ano.get("min_baseline") or 3.0,
        authorization=bool(authz.get("enabled", False)),
        default_role=authz.get("default_role") or "viewer",
        roles=roles,
        client_roles=dict(authz.get("client_roles") or {}),
        response=bool(resp.get("enabled", False)),
        default_strategy=resp.get("default_strategy") or "NOTIFY_ONLY",
        block_mode=resp.get("block_mode") or "IMMEDIATE",
        response_rules=response_rule_rows(resp.get("rules", [])),
        routing_rules=routing_rule_rows(conf.get("routing_rules", [])),
        agent=bool(agent.get("enabled", False)),
        agent_provider=agent.get("provider") or "mock",
        max_loop_depth=agent.get("max_loop_depth") or 5,
        allowed_actions=list(agent.get("allowed_actions") or ["AI_ANALYZE"]),
        min_severity=agent.get("min_severity") or "LOW",
        brand=conf.get("brand") or "Logwarden",
    )


def task_rule_rows(rows: list[dict]) -> list[dict]:
    return [_filled(r, TASK_RULE, i) for i, r in enumerate(rows)]


def routing_rule_rows(rows: list[dict]) -> list[dict]:
    return [_filled(r, ROUTING_RULE, i) for i, r in enumerate(rows)]


def response_rule_rows(rows: list[dict]) -> list[dict]:
    return [_filled(r, RESPONSE_RULE, i) for i, r in enumerate(rows)]


__all__ = [
    "CHAIN_STEP", "EXEC_PARAMS", "GUARDRAILS", "INLINE_LIMIT", "DynamicRule", "MaskPolicy", "MaskRule",
    "RuleSet", "dynamic_rule", "literal", "load_rules", "mask_rules", "response_rule_rows",
    "routing_rule_rows", "sql_literal", "sql_text", "task_rule_rows",
]

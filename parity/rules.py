"""Rule tables the queries run with."""

from __future__ import annotations

from logwarden.config import load_rules

HMAC_KEY = b"0123456789abcdef0123456789abcdef"
OLD_KEY = b"fedcba9876543210fedcba9876543210"

CONF = {
    "brand": "Logwarden",
    "security": {
        "hmac_key": HMAC_KEY,
        "enable_hash_chain": True,
        "preserve_fields": ["traceId", "spanId", "ip"],
        "masking_rules": [
            {"type": "PII_TYPE", "category": c}
            for c in ("EMAIL", "CREDIT_CARD", "PHONE", "GOVERNMENT_ID", "JAPAN_ACCOUNT", "POSTAL_CODE")
        ],
    },
    "flow": {
        "service_id": "demo-service",
        "rules": [
            {"rule_id": "crit-notify", "event_name": "SYSTEM_CRITICAL_FAILURE", "severity": "HIGH",
             "action_type": "SYSTEM_NOTIFICATION", "execution_level": "AUTO", "priority": 2,
             "description": "Notify on critical system failure",
             "exec_params": {"notification_channel": "#incidents"},
             "guardrails": {"require_human_approval": False, "timeout_ms": 30000, "max_retries": 3}},
            {"rule_id": "crit-kill", "event_name": "SYSTEM_CRITICAL_FAILURE", "severity": "CRITICAL",
             "action_type": "KILL_SWITCH", "execution_level": "SEMI_AUTO", "priority": 1,
             "description": "Stop the component",
             "exec_params": {"script_identifier": "stop-component"},
             "guardrails": {"require_human_approval": False, "timeout_ms": 1000, "max_retries": 0}},
            {"rule_id": "sec-analyze", "event_name": "SECURITY_INTRUSION_DETECTED", "severity": "HIGH",
             "action_type": "AI_ANALYZE", "execution_level": "AUTO", "priority": 1,
             "description": "AI analysis of security intrusion",
             "guardrails": {"require_human_approval": False, "timeout_ms": 60000, "max_retries": 2}},
            {"rule_id": "sec-watch", "event_name": "SECURITY_INTRUSION_DETECTED", "severity": "LOW",
             "action_type": "SYSTEM_NOTIFICATION", "execution_level": "MONITOR", "priority": 5,
             "description": "Watch <intrusions> & report"},
            {"rule_id": "comp-escalate", "event_name": "COMPLIANCE_VIOLATION", "severity": "MEDIUM",
             "action_type": "ESCALATE", "execution_level": "MANUAL", "priority": 1,
             "description": "Escalate compliance violation to legal team",
             "exec_params": {"notification_channel": "#legal-compliance"},
             "guardrails": {"require_human_approval": True, "timeout_ms": 86400000, "max_retries": 0}},
        ],
    },
    "ensemble": {
        "enabled": True, "aggregator": "max", "threshold": 0.5,
        "dynamic_rules": [
            {"rule_id": "brute-force", "event_name": "SECURITY_INTRUSION_DETECTED", "priority": "HIGH", "score": 0.95,
             "payload_builder": "security_intrusion", "log_types": ["SECURITY"], "min_level": 4,
             "message_pattern": r"(?i)brute\s*force"},
            {"rule_id": "tagged", "event_name": "COMPLIANCE_VIOLATION", "priority": "none", "score": 0.0,
             "payload_builder": "compliance_violation", "origins": ["SYSTEM"], "max_level": 3, "tag_keys": ["ip"],
             "require_critical": False},
            {"rule_id": "faint", "event_name": "AI_ACTION_REQUIRED", "priority": "LOW", "score": 0.3,
             "payload_builder": "other", "log_types": ["BUSINESS-AUDIT", "SYSTEM"], "min_level": 5},
        ],
    },
    "authorization": {
        "enabled": True, "default_role": "viewer",
        "roles": {
            "admin": {"can_write": True, "can_read": True, "can_approve": True, "can_admin": True},
            "writer": {"can_write": True, "can_read": True, "denied_log_types": ["sla"], "max_log_level": 5},
            "auditor": {"can_write": True, "can_approve": True, "allowed_log_types": ["Compliance", "SECURITY"]},
            "viewer": {"can_read": True},
        },
        "client_roles": {"client-0": "admin", "client-1": "writer", "client-2": "auditor", "client-3": "gone"},
    },
    "response": {
        "enabled": True, "default_strategy": "MONITOR",
        "rules": [
            {"event_name": "SECURITY_INTRUSION_DETECTED", "strategy": "BLOCK_AND_NOTIFY", "block_action": "block_ip",
             "min_priority": "HIGH", "notify_targets": ["#security", "x@example.com"]},
            {"event_name": "SYSTEM_CRITICAL_FAILURE", "strategy": "ANALYZE_AND_NOTIFY", "min_priority": "HIGH",
             "analysis_prompt": "Why did it fail?", "notify_targets": ["ops@example.com"]},
            {"event_name": "COMPLIANCE_VIOLATION", "strategy": "BLOCK_ONLY", "block_action": "lock_account"},
            {"event_name": "AI_ACTION_REQUIRED", "strategy": "BLOCK_ONLY", "block_action": "revoke_token"},
            {"event_name": "", "strategy": "NOTIFY_ONLY", "min_priority": "HIGH",
             "notify_targets": ["https://hook.example.com"]},
        ],
    },
    "masking_policies": [
        {"policy_id": "sec-strict", "log_types": ["SECURITY"],
         "masking_rules": [{"type": "PII_TYPE", "category": "EMAIL"},
                           {"type": "REGEX", "pattern": r"(10)\.0\.(\d+)", "replacement": "${1}.x.$2"}],
         "preserve_extra": ["actorId"]},
        {"policy_id": "high-level", "min_level": 4,
         "masking_rules": [{"type": "PII_TYPE", "category": "PHONE"},
                           {"type": "PII_TYPE", "category": "CREDIT_CARD"}]},
        {"policy_id": "agent", "origins": ["AI_AGENT"], "max_level": 3,
         "masking_rules": [{"type": "PII_TYPE", "category": "GOVERNMENT_ID"}], "preserve_extra": ["note"]},
    ],
    "routing_rules": [
        {"rule_id": "comp-high", "min_level": 4, "max_level": 6, "event_name": "COMPLIANCE_VIOLATION",
         "chain": [{"step_order": 1, "role": "team_lead", "required": True},
                   {"step_order": 2, "role": "manager", "required": True},
                   {"step_order": 3, "role": "legal", "required": True}]},
        {"rule_id": "any-low", "min_level": 1, "max_level": 2, "event_name": "",
         "chain": [{"step_order": 1, "role": "team_lead", "required": True},
                   {"step_order": 2, "role": "manager", "required": True}]},
        {"rule_id": "comp-empty", "min_level": 1, "max_level": 1, "event_name": "COMPLIANCE_VIOLATION", "chain": []},
    ],
    "agent": {"enabled": True, "allowed_actions": ["AI_ANALYZE"], "min_severity": "HIGH", "max_loop_depth": 5},
}


def rules():
    return load_rules(CONF)

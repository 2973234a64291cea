"""Deterministic stand-ins for model calls, for queries and tests only."""

from __future__ import annotations


def stub_analysis(prompt: str, context: dict) -> dict:
    """Deterministic stand-in for a model call."""
    risk = {"HIGH": "high", "MEDIUM": "medium"}.get(context["priority"], "low")
    return {
        "summary": f"{context['event_name']} at {context['boundary']}", "risk_level": risk,
        "confidence": 0.9 if risk == "high" else 0.6, "indicators": [context["type"]],
        "recommended": "review", "model": "stub", "tokens_used": len(prompt),
    }


def stub_inference(task: dict) -> dict:
    """Deterministic stand-in for a model call."""
    sure = {"CRITICAL": 0.95, "HIGH": 0.85}.get(task["severity"], 0.5)
    return {"thought": f"{task['event_name']} at {task['source_boundary']}", "action": task["action_type"].lower(),
            "confidence": sure, "model": "stub", "tokens_used": len(task["source_message"] or "")}

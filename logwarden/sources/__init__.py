"""Readers and append-only writers for the log and audit tables."""

"""Operators assembled into whole plans."""

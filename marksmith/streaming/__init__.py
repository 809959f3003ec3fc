"""Structured Streaming operators (optional extension X1)."""

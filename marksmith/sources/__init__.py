"""Readers and writers."""

from marksmith.sources.readers import (
    read_instructions, read_key_list, read_pairs, read_table, read_templates, read_words,
)
from marksmith.sources.sinks import append_runs, export_rows, write_pairs

__all__ = [
    "read_table", "read_key_list", "read_pairs", "read_templates", "read_words",
    "read_instructions", "write_pairs", "export_rows", "append_runs",
]

"""Delimited text sources."""

from .csv import Dialect, input_bytes, read_text
from .structure import field_counts, structure_report

__all__ = [
    "Dialect",
    "field_counts",
    "read_text",
    "input_bytes",
    "structure_report",
]

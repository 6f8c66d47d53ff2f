"""Readers and writers."""

from .readers import infer_format, list_tables, read, read_records, read_texts
from .writers import convert, write, write_auto, write_splits

__all__ = ["convert", "infer_format", "list_tables", "read", "read_records", "read_texts", "write", "write_auto", "write_splits"]

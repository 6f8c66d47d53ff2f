"""Incremental runs of the row-local operators."""

from .incremental import convert_stream, drop_repeated, read_stream, write_stream

__all__ = ["convert_stream", "drop_repeated", "read_stream", "write_stream"]

"""Readers of binary formats and the sinks."""

"""Incremental work on streams of new records."""

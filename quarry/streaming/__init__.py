"""Incremental and streaming forms of the plans."""

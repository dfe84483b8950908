"""Structured Streaming forms of incremental loading (an extension)."""

"""Incremental upkeep of the measure cube with Structured Streaming."""

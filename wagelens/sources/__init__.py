"""Readers of the canonical inputs, the test-table adapter, and writers."""

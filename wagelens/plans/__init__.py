"""Report plans and profiles."""

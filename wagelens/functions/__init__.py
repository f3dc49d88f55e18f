"""Column expressions: money arithmetic and display texts."""

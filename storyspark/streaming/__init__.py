"""streaming of the storyspark engine."""

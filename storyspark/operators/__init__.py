"""operators of the storyspark engine."""

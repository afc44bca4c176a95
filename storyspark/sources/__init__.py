"""sources of the storyspark engine."""

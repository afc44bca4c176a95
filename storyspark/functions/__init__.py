"""functions of the storyspark engine."""

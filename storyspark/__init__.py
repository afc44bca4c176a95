"""storyspark: analytics over collections of interlinked documents, on Spark DataFrames."""

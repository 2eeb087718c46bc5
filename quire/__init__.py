"""Document-structure analytics on Spark: DataFrames in, DataFrames out."""

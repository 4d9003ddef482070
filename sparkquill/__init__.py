"""Text retrieval analytics on Spark DataFrames."""

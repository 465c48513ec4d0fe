"""News-sentiment analytics on Spark DataFrames."""

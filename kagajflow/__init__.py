"""Document retrieval and civic analytics on Spark DataFrames."""

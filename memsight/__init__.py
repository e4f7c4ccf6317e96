"""Server memory-error analytics on Spark DataFrames."""

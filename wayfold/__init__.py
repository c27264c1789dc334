"""Movement-data analytics on Spark DataFrames."""

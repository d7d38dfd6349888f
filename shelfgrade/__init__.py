"""Product-quality analytics on Spark DataFrames."""

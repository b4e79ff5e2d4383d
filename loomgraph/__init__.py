"""Production-network analytics on Spark DataFrames."""

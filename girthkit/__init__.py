"""Graph-corpus analytics on Spark DataFrames."""

"""Value-graph analytics on Spark DataFrames."""

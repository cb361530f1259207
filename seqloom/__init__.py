"""seqloom: sequence matching and match analytics on Spark DataFrames."""

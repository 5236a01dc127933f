"""Privacy-preserving record linkage on Spark DataFrames."""

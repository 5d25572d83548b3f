"""k-mer membership analytics on Spark DataFrames."""

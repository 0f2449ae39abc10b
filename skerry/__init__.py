"""skerry: forecast comparison, pooling and verification jobs on Spark DataFrames."""

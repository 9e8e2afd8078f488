"""Frame-sequence and alpha-matte analytics on Spark DataFrames."""

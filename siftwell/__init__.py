"""siftwell: feature screening and data-quality analytics on Spark DataFrames."""

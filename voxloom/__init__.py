"""voxloom: speaker-attributed conversation analytics on Spark DataFrames."""

"""emberlog: log-incident analytics on Spark DataFrames."""

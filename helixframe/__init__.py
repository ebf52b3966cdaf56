"""Population analytics on Spark DataFrames."""

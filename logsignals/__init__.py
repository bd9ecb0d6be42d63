"""Log and corpus analytics on Spark DataFrames."""

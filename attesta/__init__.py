"""Document-evidence analytics on Spark: every operator maps DataFrames to a lazy DataFrame."""

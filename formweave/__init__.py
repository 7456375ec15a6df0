"""Document and form analytics on Spark DataFrames."""

"""Hotel-review analytics and retrieval on Spark DataFrames."""

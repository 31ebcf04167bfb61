"""contigua: sequence-read analytics on Spark DataFrames."""

"""tidemark: similarity scoring, vector search and corpus preparation on Spark DataFrames."""

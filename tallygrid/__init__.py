"""Top-k similarity search by match count on Spark DataFrames."""

"""Question answering and corpus preparation on Spark DataFrames."""

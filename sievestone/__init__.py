"""Text retrieval, question answering and corpus preparation on Spark DataFrames."""

"""Text-corpus and topic analytics on Spark DataFrames."""

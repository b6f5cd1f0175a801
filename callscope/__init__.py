"""Text analytics over long transcripts and documents, on Spark DataFrames."""

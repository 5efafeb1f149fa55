"""Media-provenance analytics on Spark DataFrames and Structured Streaming."""

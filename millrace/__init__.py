"""millrace: permission-aware hybrid retrieval, its ingest and its evaluation, as Spark DataFrames."""

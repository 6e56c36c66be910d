"""textlake: Hebrew-aware retrieval and document-text processing on Spark DataFrames."""

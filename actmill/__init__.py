"""Document retrieval, extraction and regulatory-text analytics on Spark DataFrames."""

"""Document analytics on Spark: cleaning, chunking, retrieval, extraction and evaluation."""

"""textlake: Spark-first building and querying of text-retrieval corpora."""

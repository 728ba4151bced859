"""A Spark-first engine for structured contract documents, their clause vectors and the retrieval built on them."""

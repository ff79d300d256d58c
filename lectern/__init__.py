"""Document processing and retrieval analytics as Spark DataFrame operators."""

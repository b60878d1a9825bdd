"""Evidence retrieval, ranking and evaluation as Spark DataFrame operators."""

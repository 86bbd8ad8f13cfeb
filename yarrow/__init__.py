"""yarrow: document preparation, hybrid retrieval and evaluation as Spark DataFrame transforms."""

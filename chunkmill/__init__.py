"""Spark jobs that prepare documents for retrieval and query them."""

"""Spark jobs that turn document collections into a deduplicated, cited knowledge base."""

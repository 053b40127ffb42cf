"""Spark-first corpus preparation, lexical retrieval and corpus linting."""

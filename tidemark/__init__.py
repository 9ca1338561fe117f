"""Tidemark: corpus migration analytics as Spark DataFrame operators."""

"""Paired-signal analytics expressed as Spark DataFrame operations."""

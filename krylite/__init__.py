"""Sparse-vector analytics on Spark: randomised sparse linear algebra expressed as DataFrame operations."""

"""Hierarchical grouping and review routing as Spark DataFrame jobs."""

"""A Spark-first engine for filter programs over semi-structured data."""

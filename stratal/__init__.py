"""A Spark-first engine for flat and nested columnar data."""

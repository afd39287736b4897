"""Spark-first record matching, profiling and corpus preparation."""

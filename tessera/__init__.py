"""Spark-first analytics for wide, small-sample tables and for text corpora."""

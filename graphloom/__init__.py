"""Spark-first analytics over page, link and category tables."""

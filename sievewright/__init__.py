"""Spark-first dataset curation, audit and evaluation analytics."""

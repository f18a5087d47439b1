"""Corpus preparation, hybrid search, rule checks and evaluation analytics as Spark DataFrame operators."""

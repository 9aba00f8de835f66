"""Spark-first operators for judged-competition results."""

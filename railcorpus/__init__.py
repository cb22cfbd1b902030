"""Spark-native analytics for short-text corpora."""

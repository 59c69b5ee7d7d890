"""Spark-native analytics for text and source-code corpora."""

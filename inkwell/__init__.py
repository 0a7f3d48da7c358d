"""Spark-native full-text search, link analysis and corpus preparation."""

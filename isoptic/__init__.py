"""Spark-native analytics for ordered recordings."""

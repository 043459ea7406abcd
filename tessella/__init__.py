"""Spark-native analytics for long-format sensor and event series."""

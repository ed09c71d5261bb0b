"""Spark-native analytics for human-motion time series."""

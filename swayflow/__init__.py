"""Spark-native analytics for small-movement time series."""

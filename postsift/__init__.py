"""Spark-native text-insight analytics."""

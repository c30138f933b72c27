"""Spark-native label-compliance analytics."""

"""Spark-native evaluation-audit analytics."""

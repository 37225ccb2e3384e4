"""Spark-native vector analytics."""

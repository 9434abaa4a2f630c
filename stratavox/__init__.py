"""Spark-native geometric and spatial stream analytics."""

"""Spark-native analytics for road-sensing recordings."""

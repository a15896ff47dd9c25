"""Spark-native analytics for tracked-motion sessions."""

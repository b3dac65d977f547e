"""Spark-native analytics for multi-channel physiological recordings."""

"""Spark-native analytics for an online learning community."""

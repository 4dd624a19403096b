"""Spark-native analytics for tracked particles, their mechanics, and text corpora."""

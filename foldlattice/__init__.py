"""Spark-native motif search and census analysis over interaction matrices."""

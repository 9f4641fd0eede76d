"""Spark-native product decision analytics."""

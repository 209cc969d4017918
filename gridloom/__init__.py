"""Spark-native analytics over gridded intensity volumes."""

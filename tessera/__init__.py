"""Spark-native analytics engine for recognised text."""

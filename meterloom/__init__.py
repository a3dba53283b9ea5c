"""Spark-native analytics over the session logs of AI coding tools."""

"""Spark-native analytics over outline-style documents."""

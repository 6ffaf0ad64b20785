"""Spark-native analytics over scored records: see README.md."""

"""Spark-native analytics over source trees, graphs, documents and vectors."""

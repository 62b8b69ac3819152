"""Spark-native signal, retrieval and data-quality engine."""

"""A Spark-native engine for verifiable, append-only event streams."""

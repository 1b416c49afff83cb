"""Spark-native operators for web-discovery and document-corpus data."""

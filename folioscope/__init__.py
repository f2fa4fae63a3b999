"""Spark-native document-outline analytics."""

__version__ = "0.1.0"

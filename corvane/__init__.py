"""Spark-native retrieval, chunking and evaluation over long structured documents."""

__version__ = "0.1.0"

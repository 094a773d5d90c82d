"""Spark-native record linkage and address analytics."""

__version__ = "0.1.0"

"""Spark-native counting and analysis of canonical DNA k-mers."""

__version__ = "0.1.0"

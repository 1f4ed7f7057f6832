"""Spark-native conformance analysis over a corpus of text and source files."""

__version__ = "0.1.0"

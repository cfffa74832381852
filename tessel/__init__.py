"""Tessel: a Spark-native question-answering and data-preparation engine."""

__version__ = "0.1.0"

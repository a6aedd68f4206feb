"""Spark-native building, auditing, transforming and scoring of audio data sets held as tables."""

__version__ = "0.1.0"

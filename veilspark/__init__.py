"""Spark-native log, text and record sanitizing."""

__version__ = "0.1.0"

"""Spark-native order-record analytics: table structuring, normalisation, matching, review and run state."""

__version__ = "0.1.0"

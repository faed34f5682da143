"""Spark-native operators for event-delivery data.

Every operator takes a DataFrame plus frozen configuration and returns a
DataFrame, so the same code runs on a batch table and, where the semantics
allow it, on a Structured Streaming source.
"""

__version__ = "0.1.0"

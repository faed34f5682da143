"""Structured Streaming twins of the keyed operators."""

"""Readers, parsers of landed records, and writers."""

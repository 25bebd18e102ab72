"""Readers, column mapping, import validation and writers."""

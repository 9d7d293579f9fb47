"""Readers, text extractors and writers."""

"""Structured Streaming forms of the ordered operators."""

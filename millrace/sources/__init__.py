"""Readers and writers of text formats."""

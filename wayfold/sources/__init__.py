"""Readers and writers of the working tables."""

"""Readers and writers for the corpus file formats."""

"""Structured Streaming forms of the detectors and windowed views."""

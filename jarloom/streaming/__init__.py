"""Structured Streaming: the corpus as records arrive."""

"""Provenance analytics on Spark: a columnar corpus of archives, files and class signatures, and exact set similarity over it."""

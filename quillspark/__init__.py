"""Corpus quality and provenance queries on Spark."""

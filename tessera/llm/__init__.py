"""Operators on text corpora and embeddings."""

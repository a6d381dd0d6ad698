"""Operators on text corpora and embeddings: deduplication, filtering, tokenizing and packing."""

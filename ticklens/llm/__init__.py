"""Operators of a training-data pipeline over raw pages, documents and embeddings."""

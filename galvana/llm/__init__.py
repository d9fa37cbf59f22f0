"""Operators of training-data pipelines over text, conversations and embeddings."""

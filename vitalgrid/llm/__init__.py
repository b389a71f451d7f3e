"""Operators for training-data pipelines over tables of documents, pages and embeddings."""

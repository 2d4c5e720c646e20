"""Retrieval and code-corpus analytics on Spark: scan, chunk, embed, index, search, and navigate."""

__version__ = "0.1.0"

"""Corpus-scale wiki and web document processing on PySpark."""

"""Tessera: a PySpark-native engine for code-knowledge graphs, change history and text corpora."""

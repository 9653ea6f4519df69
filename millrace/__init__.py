"""Millrace: a PySpark-native engine for preparing language-model training corpora."""

"""Quernstone: a PySpark-native library for relational, text-corpus and streaming data processing."""

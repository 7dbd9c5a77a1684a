"""Spark-native literature analytics: bibliography, chunks, retrieval, coverage and text-pipeline operators."""

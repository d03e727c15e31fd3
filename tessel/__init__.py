"""Spark-native analytics over question-answering, evidence and text corpora."""

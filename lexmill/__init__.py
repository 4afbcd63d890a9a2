"""Spark-first engine for building and analysing language-model training corpora."""

"""Curatrix: a Spark-native engine for corpus curation and record matching."""

"""Spark-native object-audio analytics: operators, sources, functions, plans and streaming helpers."""

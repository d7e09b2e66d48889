"""Spark-native ELT and data governance on DataFrames."""

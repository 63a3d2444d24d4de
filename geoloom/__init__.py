"""Spark-native geospatial dataset engine."""

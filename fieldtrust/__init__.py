"""Spark-native trust layer over machine-extracted document fields."""

"""Spark-native analytics over corpora of loosely formatted, cross-referencing text tables."""

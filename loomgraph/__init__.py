"""Spark-native analytics over text corpora and property graphs."""

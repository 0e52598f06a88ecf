"""Spark-native sequential experimentation and training-data operators."""

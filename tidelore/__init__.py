"""Spark-native conversational memory engine with training-data operators."""

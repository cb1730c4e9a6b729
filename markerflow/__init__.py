"""Spark-native analytics over labelled, time-indexed point and vector sequences."""

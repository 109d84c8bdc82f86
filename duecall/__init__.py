"""Spark-native analytics over submission calls, venues and their papers."""

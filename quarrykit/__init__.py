"""Spark-native data preparation, exploratory statistics and corpus engineering."""

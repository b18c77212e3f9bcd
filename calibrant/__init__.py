"""Spark-native audit engine for text classifiers."""

"""Spark-native audit engine for evaluation datasets."""

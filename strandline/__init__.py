"""Spark-native engine for building training samples from multi-rate recordings."""

"""Spark-native architecture analytics and corpus preparation."""

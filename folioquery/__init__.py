"""Spark-native document retrieval and corpus quality analytics."""

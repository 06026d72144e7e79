"""Spark-native extraction, linking and lookup of knowledge about software APIs."""

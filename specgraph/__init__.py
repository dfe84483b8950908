"""Spark-native engine for requirement documents and the property graphs derived from them."""

"""Lumenweft: a PySpark-native engine for media, page and manifest analytics."""

"""Verdanta: a PySpark-native engine for sustainability-disclosure data."""

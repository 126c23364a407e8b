"""Terrane: a PySpark-native engine for reservoir history-matching data."""

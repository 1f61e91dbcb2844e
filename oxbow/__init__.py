"""Oxbow: a PySpark-native file-catalogue and corpus analytics engine."""

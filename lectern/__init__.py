"""Lectern: a PySpark-native retrieval-readiness and corpus-quality engine."""

__version__ = "0.1.0"

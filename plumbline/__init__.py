"""plumbline: a PySpark-native engine for source-repository analytics and retrieval."""

__version__ = "0.1.0"

"""veldmark: a PySpark-native document conversion and corpus engine."""

__version__ = "0.1.0"

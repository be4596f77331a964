"""tabbyline: a PySpark-native engine for building, checking and searching text corpora."""

__version__ = "0.1.0"

"""roadloom: a PySpark-native engine for dynamic network count data."""

__version__ = "0.1.0"

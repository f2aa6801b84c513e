"""siftmark: a PySpark-native engine for checking the integrity of labelled text corpora."""

__version__ = "0.1.0"

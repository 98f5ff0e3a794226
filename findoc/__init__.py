"""PySpark-native analytics engine for financial documents."""

__version__ = "0.1.0"

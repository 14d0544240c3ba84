"""vitaeflow: a PySpark-native analytics engine for candidate and job documents."""

__version__ = "0.1.0"

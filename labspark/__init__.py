"""labspark: a PySpark-native analytics engine for laboratory and life-science tables."""

__version__ = "0.1.0"

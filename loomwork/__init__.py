"""loomwork: a PySpark-native engine for event feeds, binary containers and pixel statistics."""

__version__ = "0.1.0"

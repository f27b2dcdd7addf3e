"""A PySpark-native analytics engine for messy tabular data."""

"""A PySpark-native engine for interval, count and single-cell style analytics."""

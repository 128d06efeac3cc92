"""A PySpark-native engine for syndicated content."""

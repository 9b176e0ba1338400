"""A PySpark-native engine for structural-variation analytics."""

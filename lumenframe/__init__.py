"""A PySpark-native analytics engine for large media libraries."""

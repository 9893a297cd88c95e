"""A PySpark-native analytics engine for exact, reproducible signal processing."""

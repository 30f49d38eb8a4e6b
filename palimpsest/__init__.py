"""Spark-native analytics over versioned, content-addressed collections."""

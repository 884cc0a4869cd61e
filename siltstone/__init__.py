"""PySpark-native corpus analytics."""

"""A PySpark-native engine for searching and curating web-archive collections."""

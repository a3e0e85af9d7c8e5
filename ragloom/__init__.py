"""A PySpark-native engine for retrieval-style document analytics."""

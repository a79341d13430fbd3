"""Bidloom: a PySpark-native engine for comparing priced bills of quantities."""

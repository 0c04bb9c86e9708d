"""Typed columnar statistics, encodings and ORC storage as Spark DataFrame operations."""

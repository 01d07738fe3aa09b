"""Relational operators that Spark has no node for: k nearest neighbours, exact ranks."""

"""Relational operators of the dialect, written as Spark SQL."""

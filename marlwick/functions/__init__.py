"""Expressions of the dialect as Spark SQL text."""

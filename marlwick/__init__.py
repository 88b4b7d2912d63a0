"""A PySpark-native engine for a strict, PostgreSQL-flavoured SQL dialect."""

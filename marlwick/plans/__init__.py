"""From the text of a statement to its Spark SQL."""

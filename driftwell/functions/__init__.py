"""Column functions; all are built of Spark's own expressions."""

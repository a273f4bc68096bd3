"""Personal-data analytics as Spark jobs."""

"""ratewise: recommendation analytics as Spark DataFrame jobs."""

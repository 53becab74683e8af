"""Launch analytics as Spark jobs."""

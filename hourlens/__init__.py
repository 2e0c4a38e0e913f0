"""Work-hour question analytics as Spark DataFrame jobs."""

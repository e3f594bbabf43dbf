"""Survey and panel analytics as Spark DataFrame jobs."""

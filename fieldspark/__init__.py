"""Radio-field and measurement analytics as Spark DataFrame jobs."""

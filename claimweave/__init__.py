"""Evidence and claim analytics as plain Spark DataFrame jobs."""

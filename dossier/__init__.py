"""Document and evidence analytics as Spark DataFrame jobs."""

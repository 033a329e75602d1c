"""Election and civic-proposal analytics as Spark DataFrame jobs."""

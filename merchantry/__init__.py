"""Commerce analytics over order tables, written as Spark DataFrame jobs."""

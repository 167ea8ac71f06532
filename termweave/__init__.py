"""termweave: schema-term matching and corpus preparation as Spark DataFrame jobs."""

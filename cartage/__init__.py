"""cartage: Spark-first analytics for multi-tenant service-job data."""

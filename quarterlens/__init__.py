"""Report corpus analytics on Spark: column rules, window rankings and idempotent ingestion."""

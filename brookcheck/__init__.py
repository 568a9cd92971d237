"""Rule-driven data quality for tables and streams of records on Spark."""

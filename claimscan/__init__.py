"""claimscan: content-compliance jobs over large tables, as Spark DataFrame jobs."""

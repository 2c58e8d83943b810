"""Entity tracking, scoring and ranking as plain DataFrame jobs over Parquet."""

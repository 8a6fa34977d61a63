"""Readers: test-data parquet, derived fixtures, the delivered CSV file."""

"""Readers: parquet tables, tolerant CSV, SQL tables, HTML pages, literal tables."""

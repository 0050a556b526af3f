"""Structured Streaming ingest of CSV files."""

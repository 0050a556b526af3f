"""Scans: CSV line parser (batch and stream), directory and single-file imports, table scans."""

"""Composed jobs: batch ingest, build-with-tests, export."""

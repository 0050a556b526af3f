"""fleetlake — vehicle telemetry tables and streams on Spark.

Subpackages:

* ``functions`` – scalar column functions (null tokens, numbers, ISO time, names)
* ``sources``   – CSV line parser, directory/single-file scans, table scans
* ``operators`` – validation, dedup, identity, list queries, statistics, marts, data tests
* ``sinks``     – idempotent partitioned table writes, reject table, JSON/CSV export files
* ``plans``     – composed jobs: batch ingest, build-with-tests, export
* ``streaming`` – the Structured Streaming ingest
"""

__version__ = "0.1.0"

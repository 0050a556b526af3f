"""Writers: idempotent partitioned table, rejects, JSON/CSV export files."""

"""DataFrame → DataFrame operators: validation, dedup, identity, queries, statistics, marts, data tests."""

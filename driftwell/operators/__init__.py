"""DataFrame to DataFrame operators of the replication engine."""

"""Change-log replication analytics as PySpark DataFrame operations."""

"""Rollback-aware event analytics on Spark."""

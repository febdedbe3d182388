"""Queries and updates of the workload."""

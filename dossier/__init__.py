"""Spark jobs over auditable public-record archives."""

"""Whole plans: ingest paths put together, and the registered queries over the given tables."""

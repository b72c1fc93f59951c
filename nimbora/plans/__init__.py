"""Composite queries and the catalog of all queries with their SQL."""

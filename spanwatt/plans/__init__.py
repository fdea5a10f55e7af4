"""Whole jobs over the given tables, as queries with their SQL."""

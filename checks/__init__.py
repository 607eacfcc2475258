"""Queries over the given tables, each with the same question asked in SQL."""

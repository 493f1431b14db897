"""Queries that bind the operators to the plain tables."""

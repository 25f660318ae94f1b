"""Profiling plans: roles, relations, groupings and distributions of a table."""

"""Queries over the given tables, each with SQL that says what it must return."""

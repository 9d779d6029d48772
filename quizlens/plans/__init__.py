"""Queries over the shared tables, and the SQL that gives the same rows."""

"""Queries over the test tables, with the SQL that must agree."""

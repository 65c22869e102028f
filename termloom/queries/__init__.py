"""Registered queries over a folder of tables, and SQL that gives the same rows."""

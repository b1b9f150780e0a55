"""Queries over the test tables: page templates, registered queries, their SQL."""

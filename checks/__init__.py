"""Queries over the driver's tables, each with the SQL that must agree with it."""

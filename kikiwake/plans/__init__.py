"""Queries over the driver's tables, each beside SQL that says the same."""

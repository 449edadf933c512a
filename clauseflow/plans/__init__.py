"""Registered queries, the tables they run on, and SQL to compare them with."""

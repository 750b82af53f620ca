"""Operators over a table or over its profile."""

"""Whole profiles, made of a few passes over the table."""

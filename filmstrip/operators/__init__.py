"""Operators over library tables, each a DataFrame function."""

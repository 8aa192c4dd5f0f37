"""Whole queries: the library plan, and the registered queries with their SQL."""

from . import catalog, media  # noqa: F401  both register queries

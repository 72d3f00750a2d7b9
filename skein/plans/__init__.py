"""The library's queries over the test tables."""

from . import compatibility, packages, queries, sources

__all__ = ["compatibility", "packages", "queries", "sources"]

"""Named queries over the test tables, each with the SQL that must give the same result."""

from skyledger.registry.book import QUERIES

__all__ = ["QUERIES"]

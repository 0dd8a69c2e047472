"""The registered grid queries and their SQL."""

from wetcell.queries.registry import QUERIES, SQL, flagship

__all__ = ["QUERIES", "SQL", "flagship"]

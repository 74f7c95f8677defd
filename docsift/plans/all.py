"""Importing this module registers all queries but those of the training-data operators."""

from docsift.plans import report_queries, structure_queries, text_queries  # noqa: F401
from docsift.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

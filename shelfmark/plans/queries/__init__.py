"""All registered queries."""

from shelfmark.plans.queries import accounting, dumps, merging, scalars, searching  # noqa: F401
from shelfmark.plans.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

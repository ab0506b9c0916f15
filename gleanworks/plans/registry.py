"""All named queries, and their SQL."""

from gleanworks.plans import part_queries, source_queries  # noqa: F401  they register themselves
from gleanworks.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

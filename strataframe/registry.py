"""Registered queries and the SQL they are checked against."""

from .plans import analyses  # noqa: F401  registers its queries
from .plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "distance_matched_auroc"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

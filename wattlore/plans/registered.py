"""All registered queries of the analytics operators: importing the modules fills the two tables."""

from . import coverage_queries, evidence_queries, operator_queries, search_queries  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

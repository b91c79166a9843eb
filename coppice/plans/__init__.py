"""Whole reports put together from the operators, and the checked queries."""

from coppice.plans import checked_code, checked_graph, checked_lexis, checked_text, checked_tree  # noqa: F401
from coppice.plans.registry import QUERIES

__all__ = ["QUERIES"]

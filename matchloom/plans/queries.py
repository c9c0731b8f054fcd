"""All registered queries; importing the modules fills the registry."""

from matchloom.plans import input_queries, match_queries, parse_queries  # noqa: F401
from matchloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

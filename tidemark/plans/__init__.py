"""Registered queries of the store's operators, each with the SQL for the same rows."""

from tidemark.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Every runnable query with its reference SQL."""

from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

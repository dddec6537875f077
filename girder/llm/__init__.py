"""Operators of a training-data pipeline, their queries and their reference SQL."""

from girder.llm.oracles import ORACLES
from girder.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Operators for preparing training text at scale, apart from the rest of the library."""

from rankloom.llm.oracle import SQL
from rankloom.llm.queries import QUERIES

__all__ = ["QUERIES", "SQL"]

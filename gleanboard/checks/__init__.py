"""Registered queries with the SQL they are compared with."""

from . import boards, expressions, jobs, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
